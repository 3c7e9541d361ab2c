"""Language-model scoring with a weighted back-off automaton over word n-grams.

The counts of all n-grams of the training texts stay distributed (see chunks.py): every chunk of documents asks for the
n-grams that it contains and builds from the answers the part of the automaton that its own texts can visit. That part
is exact, so scores don't depend on how documents fall into chunks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quirelake.llm import chunks as C
from quirelake.llm import common

#: Words of the longest n-grams.
ORDER = 3
#: Pseudo-counts that a context gives to its shorter one (Dirichlet smoothing).
STRENGTH = 20.0
#: Taken from each known word's count, for words that were never seen.
DISCOUNT = 0.75
BASE = 0.1
#: Bits that the keys of longer n-grams go without on their way: of 10 ** 12 different n-grams, one in 10 ** 5 is counted
#: with another.
LESS_BITS = 6
#: Words that one reader of a text reads.
STRIDE = 256
CHUNK_BYTES = 4 * 1024 * 1024
#: Bytes of text for each shard of the n-gram space.
SHARD_BYTES = 8 * 1024 * 1024
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(b"" if doc_id == C.NO_ID else str(doc_id).encode()) % 10 == 0


def sequences(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of order - 1 begin marks, the words and the end of each text, in one array; and where each text starts."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) + order for w in words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(n)])
    out = np.full(starts[-1], BEGIN, dtype=np.uint64)
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], n)
    end = at == np.repeat(n, n) - 1
    out[end] = END
    out[(at >= order - 1) & ~end] = common.hash_words([w for ws in words for w in ws])
    return out, starts


def gram_keys(seq: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each place; the last n - 1 places are cut off. (Those that run into the next
    text are never looked up, see places().)"""
    m = max(0, len(seq) - n + 1)
    h = np.full(m, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + seq[i : i + m])
    return h


def places(starts: np.ndarray, n: int) -> np.ndarray:
    """Starts of all n-grams that lie within one text."""
    lengths = np.maximum(np.diff(starts) - n + 1, 0)
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[:-1], lengths)


class Level:
    """The distinct n-grams of a chunk's texts: their hashes, where one of each stands, which one starts at each place of
    the sequence (-1: none), and their training counts."""

    def __init__(self, seq: np.ndarray, starts: np.ndarray, n: int) -> None:
        where = places(starts, n)
        keys = gram_keys(seq, n)[where]
        by = np.argsort(keys)
        new = np.ones(len(by), bool)
        new[1:] = keys[by[1:]] != keys[by[:-1]]
        self.keys, self.at = keys[by[new]], where[by[new]]
        self.starting = np.full(len(seq), -1, np.int32)
        self.starting[where[by]] = np.cumsum(new) - 1
        self.counts = np.zeros(len(self.keys), np.int64)


class BackoffAutomaton:
    """A weighted automaton that reads words from left to right.

    States are the n-grams of up to order - 1 words that training has seen; state 0 is the empty one. A state has an arc
    for each word that training has after it, weighted with that word's smoothed log10 probability; the arc leads to the
    longest suffix of what has been read that is a state. A state but the empty one has a failure arc to the state without
    its first word, weighted with the log10 share of probability that it gives to the shorter context.

    levels: the n-grams of the texts that will be read, by n. What they don't contain cannot be reached by these texts."""

    def __init__(self, levels: list[Level], total: int, types: int, strength: float = STRENGTH, discount: float = DISCOUNT) -> None:
        order, total = len(levels), max(total, 1)
        self.words = max(1, len(levels[0].keys))
        unseen = discount * types / total if types else 1.0
        self.unknown = float(np.log10(unseen))
        fail, loss = [np.zeros(1, np.int64)], [np.zeros(1)]
        arcs, weights, targets = [], [], []
        states = 1
        below, p_below, state_below = None, None, None
        for n, level in enumerate(levels, 1):
            c = level.counts
            if n == 1:
                p, source, suffix = np.where(c > 0, (c - discount) / total, unseen), np.zeros(len(c), np.int64), None
            else:
                context, suffix = below.starting[level.at], below.starting[level.at + 1]
                seen = below.counts[context]
                p = np.where(seen > 0, (c + strength * p_below[suffix]) / (seen + strength), p_below[suffix])
                source = state_below[context]
            known = c > 0
            if n < order:
                state = np.where(known, states + np.cumsum(known) - 1, -1)
                states += int(known.sum())
                fail.append(np.zeros(known.sum(), np.int64) if n == 1 else state_below[suffix[known]])
                loss.append(np.log10(strength / (c[known] + strength)))
                target = state
            else:
                state = None
                target = np.zeros(len(c), np.int64) if n == 1 else state_below[suffix]
            arcs.append(source[known] * self.words + levels[0].starting[level.at[known] + n - 1])
            weights.append(np.log10(p[known]))
            targets.append(target[known])
            below, p_below, state_below = level, p, state
        # an arc is found by state * words + word in a sorted array
        arcs = np.concatenate(arcs)
        by = np.argsort(arcs)
        self.order, self.arcs, self.weight, self.target = order, arcs[by], np.concatenate(weights)[by], np.concatenate(targets)[by]
        self.fail, self.loss = np.concatenate(fail), np.concatenate(loss)
        # texts begin in the state of the begin marks, which the first place of the sequence has
        first = -1
        if order > 1 and len(levels[0].keys):
            top = levels[order - 2]
            first = 1 + sum(int((x.counts > 0).sum()) for x in levels[: order - 2]) + int((top.counts[: top.starting[0]] > 0).sum()) if top.counts[top.starting[0]] > 0 else -1
        self.start = max(0, first)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more word each, and the weights of the arcs taken: failure arcs until a state has an arc
        for the word, then that arc. A word that training doesn't have leads to the empty state."""
        out, after, todo, state = np.zeros(len(word)), np.zeros(len(word), np.int64), np.arange(len(word)), state.copy()
        while len(todo):
            key = state[todo] * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1) if len(self.arcs) else np.zeros(len(key), np.int64)
            hit = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), bool)
            out[todo[hit]] += self.weight[at[hit]]
            after[todo[hit]] = self.target[at[hit]]
            todo = todo[~hit]
            out[todo[state[todo] == 0]] += self.unknown
            todo = todo[state[todo] > 0]
            out[todo] += self.loss[state[todo]]
            state[todo] = self.fail[state[todo]]
        return after, out

    def traverse(self, words: np.ndarray, cuts: np.ndarray, stride: int = STRIDE) -> np.ndarray:
        """log10 probabilities of texts, given as numbers of levels[0] and the offsets at which texts begin (and the last
        ends): the sum of the weights of all arcs taken.

        Each text is read once from left to right, its state carried from word to word. A long text is read by several
        readers, each beginning stride words after the one before; since a state has at most order - 1 words, a reader that
        reads the last order - 1 words of its forerunner first, without weight, is then in the state in which that one
        ends. All readers take their steps together."""
        size = np.diff(cuts)
        readers = -(-size // stride)
        text = np.repeat(np.arange(len(size)), readers)
        part = np.arange(len(text)) - np.repeat(np.cumsum(readers) - readers, readers)
        begin = cuts[:-1][text] + part * stride
        end = np.minimum(begin + stride, cuts[1:][text])
        lead = np.minimum(part * stride, self.order - 1)
        by = np.argsort(begin - lead - end, kind="stable")  # the longest first, so those still reading stand in front
        text, begin, end, lead = text[by], begin[by], end[by], lead[by]
        state, out = np.where(begin - lead == cuts[:-1][text], self.start, 0), np.zeros(len(text))
        length = end - begin + lead
        for i in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -i))  # readers with more than i words
            state[:n], weight = self.step(state[:n], words[begin[:n] - lead[:n] + i])
            out[:n] += np.where(i >= lead[:n], weight, 0.0)
        return np.bincount(text, weights=out, minlength=len(size))


def score(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    A null or empty text is one end token. Repeated rows count as often as they occur. A null doc_id counts as held out
    (its text is empty). A doc_id is a whole number; another type is an error. A text longer than a chunk has a chunk of
    its own. An empty table gives no rows; without training texts every token is unknown. Other columns are ignored."""
    C.whole_ids(docs)
    chunks = C.chunked(docs, "lm-chunks", chunk_bytes)
    shards = C.shards_for(C.raw_bytes(chunks), shard_bytes)

    def requests(row: pd.Series) -> Iterator[tuple[int, int, bytes, bytes]]:
        ids, at, raw = C.open_chunk(row.meta, row.blob)
        seq, starts = sequences([raw[a:b] for a, b in zip(at, at[1:], strict=False)], order)
        train = np.array([not held_out(i) for i in ids.tolist()])
        for n in range(1, order + 1):
            where = places(starts, n)
            learn = train[np.searchsorted(starts, where, side="right") - 1]
            keys, inverse = np.unique(gram_keys(seq, n)[where], return_inverse=True)
            counts = np.bincount(inverse, weights=learn, minlength=len(keys))
            for shard, a, b in C.shard_bounds(keys, shards):
                yield shard, n, C.pack_sorted(keys[a:b] >> np.uint64(LESS_BITS if n > 1 else 0)), C.pack_counts(counts[a:b])

    begin = gram_keys(np.array([BEGIN]), 1)[0]

    def reply(n: int, pdf: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
        keys = [C.unpack_sorted(b) for b in pdf["body"]]
        seen = np.concatenate([C.unpack_counts(b) for b in pdf["extra"]])
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(inverse, weights=seen).astype(np.int64)
        if n == 1:
            own = counts * (every != begin)
            yield -1, np.array([own.sum(), np.count_nonzero(own)], ">i8").tobytes()
        ends = np.cumsum([len(k) for k in keys])
        for chunk, part in zip(pdf["chunk"], np.split(counts[inverse], ends[:-1]), strict=True):
            yield chunk, C.pack_counts(part)

    answers = C.answer(C.ask(chunks, requests), reply, "lm-answers")
    # two numbers from each shard
    own = answers.where("chunk < 0").selectExpr("sum(cast(conv(hex(substr(body, 1, 8)), 16, 10) as long)) n", "sum(cast(conv(hex(substr(body, 9, 8)), 16, 10) as long)) v").first()
    total, types = int(own["n"] or 0), int(own["v"] or 0)

    def scores(row: pd.Series, got: dict[int, list[bytes]]) -> pd.DataFrame:
        ids, at, raw = C.open_chunk(row.meta, row.blob)
        seq, starts = sequences([raw[a:b] for a, b in zip(at, at[1:], strict=False)], order)
        levels = [Level(seq, starts, n) for n in range(1, order + 1)]
        for n, level in enumerate(levels, 1):
            level.counts = np.concatenate([C.unpack_counts(b) for b in got.get(n, ())] or [np.zeros(0, np.int64)])
        model = BackoffAutomaton(levels, total, types, strength)
        tokens = places(starts, order) + order - 1  # all but the begin marks
        word = levels[0].starting[tokens]
        cuts = np.concatenate([[0], np.cumsum(np.diff(starts) - order + 1)])
        logp = model.traverse(word.astype(np.int64), cuts)
        count = levels[0].counts[word]
        base = np.log10((count + BASE) / (total + BASE * (types + 1)))
        add = lambda x: np.add.reduceat(x, cuts[:-1]) if len(x) else x  # noqa: E731  every text has its end token
        return pd.DataFrame({"doc_id": C.ids_out(ids), "held_out": [held_out(i) for i in ids.tolist()], "n_tokens": np.diff(cuts), "n_known": add((count > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base), "score": logp})

    return C.meet(chunks, answers, scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return score(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLES: dict[str, str] = {}
