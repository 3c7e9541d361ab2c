"""Exact removal of repeated substrings with distributed sparse suffix arrays, sorted by the deep-shallow method.

A string of 50 bytes (LENGTH) contains a smallest 20-byte seed by hash, so two equal strings share a seed at the same
place (a minimizer). Only seeds found in two documents or more matter. Around each of them a context of up to 30 bytes
before and 50 bytes from it holds every 50-byte string that has this seed as its smallest. Contexts of one seed meet in
one shard, where a suffix array over what follows the seeds and another over what precedes them, read backwards, tell
which contexts share which of those strings, and the smallest document of each. Chunks get that back and remove bytes.

A seed that very many chunks have, or that one chunk has very often, has contexts without bound. Its contexts aren't
sorted in one place: each of their 50-byte strings is a key of its own, by 128 bits of hash, whose smallest document is
found by aggregation, first in each chunk, so a hot string costs one row for each chunk that has it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import chunks as C
from quirelake.llm import common

LENGTH, SEED = 50, 20
BEFORE = LENGTH - SEED
WIDTH = BEFORE + LENGTH
#: Bytes of text for each shard of the seed space.
SHARD_BYTES = 4 * 1024 * 1024
#: A seed found in more chunks than HOT_CHUNKS, or in more places of one chunk than HOT_PLACES, is hot.
HOT_CHUNKS, HOT_PLACES = 256, 256
CHUNK_BYTES = 2 * 1024 * 1024
#: Multikey quicksort looks at this many bytes before blind tries take over.
SHALLOW = 32


# Deep-shallow sorting -----------------------------------------------------------------------------------------------


def shallow_sort(rows: np.ndarray, depth: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of equally long byte rows by their first bytes, 8 bytes for a key.

    A group of rows that agree so far is parted in three around a pivot, the median of its first, middle and last key:
    smaller, equal and larger ones. The equal part goes on with the next 8 bytes, the others with the same; all open
    groups are parted together. group: the groups to begin with, as ascending numbers; by default one. Returns the order,
    and the group of each place in it: places of a group agree in the first depth bytes."""
    n, width = rows.shape
    order = np.arange(n)
    deepest = -(-min(depth, width) // 8)
    if not n or not deepest:
        return order, np.zeros(n, np.int64) if group is None else group
    if min(depth, width) % 8 or width % 8:
        padded = np.zeros((n, deepest * 8), np.uint8)
        padded[:, : min(depth, width)] = rows[:, : min(depth, width)]
        rows = padded
    keys = np.ascontiguousarray(rows[:, : deepest * 8]).view(">u8").astype(np.uint64)
    first = np.zeros(n, bool)  # whether a group begins at a place
    first[0] = True
    if group is not None:
        first[1:] = group[1:] != group[:-1]
    at = np.zeros(n, np.int64)  # keys in which a place's group is known to agree
    alone = first & np.append(first[1:], True)
    todo = np.flatnonzero(~alone)
    while len(todo):
        begin = np.flatnonzero(first[todo])
        size = np.diff(np.append(begin, len(todo)))
        key = keys[order[todo], at[todo]]
        a, b, c = key[begin], key[begin + size // 2], key[begin + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        part = np.repeat(np.arange(len(begin)), size) * 3 + side
        by = np.argsort(part, kind="stable")
        part = part[by]
        order[todo] = order[todo][by]
        first[todo[1:]] = part[1:] != part[:-1]
        at[todo] += part % 3 == 1
        alone = first & np.append(first[1:], True)
        todo = todo[(at[todo] < deepest) & ~alone[todo]]
    return order, np.cumsum(first) - 1


class BlindTrie:
    """A Patricia trie of strings of one length that keeps only branching places and bytes.

    A string is first led down by its bytes at branching places alone, then compared once with the leaf it reaches;
    where the two part, the new branch goes in. Reading the trie in byte order gives the strings sorted."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    def insert(self, s: bytes, item: int) -> None:
        if self.root is None:
            self.root = (s, [item])
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node[0] == s:
            node[1].append(item)
            return
        x = int.from_bytes(s, "big") ^ int.from_bytes(node[0], "big")
        lcp = len(s) - (x.bit_length() + 7) // 8
        other, parent, node = node[0][lcp], None, self.root
        while isinstance(node, list) and node[0] < lcp:
            parent, node = node, node[1][s[node[0]]]
        leaf = (s, [item])
        if isinstance(node, list) and node[0] == lcp:
            node[1][s[lcp]] = leaf
            return
        branch = [lcp, {other: node, s[lcp]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][s[parent[0]]] = branch

    def items(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node[1])
        return out


def deep_shallow(rows: np.ndarray, depth: int = SHALLOW, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows, and the length that each shares with the one before it (the first: 0). group: rows are
    sorted within these groups only, see shallow_sort()."""
    n, width = rows.shape
    order, group = shallow_sort(rows, depth, group)
    if width > depth and n:
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.append(starts[1:], n)
        deep = np.ascontiguousarray(rows[:, depth:])
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            trie = BlindTrie()
            for i in order[a:b].tolist():
                trie.insert(deep[i].tobytes(), i)
            order[a:b] = trie.items()
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp


def suffix_array(text: bytes, depth: int = SHALLOW, width: int | None = None) -> np.ndarray:
    """The order of all suffixes of text by their first width bytes (all, by default), shorter first."""
    width = len(text) if width is None else width
    padded = np.frombuffer(text + bytes(width), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(text)] if text else np.zeros((0, 1), np.uint8)
    order, lcp = deep_shallow(rows, depth)
    # padding ties a suffix with one that goes on with zero bytes: the shorter comes first
    same = np.cumsum(lcp < width)
    return order[np.lexsort((-order, same))]


# Seeds and contexts ---------------------------------------------------------------------------------------------------


def words_at(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place of buf as one number (places up to len - 8)."""
    out = np.empty(max(0, len(buf) - 7), np.uint64)
    for i in range(8):
        v = buf[i : i + (len(buf) - i) // 8 * 8].view("<u8")
        out[i::8] = v
    return out


def seed_hashes(buf: np.ndarray) -> np.ndarray:
    w = words_at(buf)
    n = max(0, len(buf) - SEED + 1)
    return _mixed(w[:n], w[8 : 8 + n], w[SEED - 8 : SEED - 8 + n])


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A hash above 0 of the first, second and last 8 bytes of a seed."""
    with np.errstate(over="ignore"):
        return common.mix(common.mix(a * np.uint64(0xD6E8FEB86659FD93) + b) + c * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def sliding(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """f over all windows of that width, by doubling."""
    span = 1
    while span * 2 <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def seeds(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all seeds in documents that end at the offsets at: places, hashes, document numbers."""
    buf = np.frombuffer(raw, np.uint8)
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none, none.astype(np.uint64), none
    h = seed_hashes(buf)
    least = sliding(np.minimum, h, BEFORE + 1)  # of the string that starts at each place
    outside = np.zeros(len(buf) + 1, np.int64)
    starts, ends = at[:-1], at[1:]
    np.add.at(outside, np.maximum(starts, ends - LENGTH + 1), 1)
    np.add.at(outside, ends, -1)
    least[np.cumsum(outside)[: len(least)] > 0] = 0
    most = sliding(np.maximum, np.concatenate([np.zeros(BEFORE, np.uint64), least, np.zeros(BEFORE, np.uint64)]), BEFORE + 1)
    place = np.flatnonzero(most[: len(h)] == h)
    return place, h[place], np.searchsorted(at, place, side="right") - 1


def note_places(at: np.ndarray, raw: bytes) -> bytes:
    """The places of all seeds, so that they are searched for once."""
    return C.squeeze(np.diff(seeds(raw, at)[0], prepend=0).astype("<u4").tobytes())


def noted_seeds(row: pd.Series) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """ids, start offsets and bytes of a chunk; places, hashes and document numbers of its seeds, copies' left out."""
    ids, at, raw = C.open_chunk(row.meta, row.blob)
    place = np.cumsum(np.frombuffer(C.expand(row.note), "<u4"), dtype=np.int64)
    doc = np.searchsorted(at, place, side="right") - 1
    keep = ~C.flags_of(row.meta)[doc]
    place, doc = place[keep], doc[keep]
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), SEED)[place] if len(place) else np.zeros((0, SEED), np.uint8)
    return ids, at, raw, place, row_hashes(rows), doc


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """seed_hashes of rows of SEED bytes."""
    w = [np.ascontiguousarray(rows[:, i : i + 8]).view("<u8").ravel() for i in (0, 8, SEED - 8)]
    return _mixed(*w)


def contexts(raw: bytes, at: np.ndarray, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of WIDTH bytes with the seed at BEFORE, zeros beyond the document; how many bytes before and from it are real."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), np.frombuffer(raw, np.uint8), np.zeros(LENGTH, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[place].copy()
    left, right = np.minimum(BEFORE, place - at[doc]), np.minimum(LENGTH, at[doc + 1] - place)
    col = np.arange(WIDTH)
    rows[(col < BEFORE - left[:, None]) | (col >= BEFORE + right[:, None])] = 0
    return rows, left.astype(np.uint8), right.astype(np.uint8)


def context_hash(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left.astype(np.uint64) * np.uint64(256) + right
    w = np.ascontiguousarray(rows).view("<u8")
    with np.errstate(over="ignore"):
        for i in range(w.shape[1]):
            h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + w[:, i])
    return h


def differs(by: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Where, in the order by, a row isn't the same as the one before; columns may have rows of bytes."""
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = False
        for c in columns:
            c = c[by]
            unlike = c[1:] != c[:-1]
            new[1:] |= unlike.any(axis=1) if unlike.ndim > 1 else unlike
    return new


def hot_strings(rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct 50-byte strings of contexts, as two hashes each, sorted, with the smallest of their documents; and
    for each start, from 0 to BEFORE bytes before the seed, which contexts have such a string and which one it is."""
    one, two, fits = [], [], []
    for i in range(BEFORE + 1):
        fit = np.flatnonzero((left >= i) & (right >= LENGTH - i))
        words = np.zeros((len(fit), -(-LENGTH // 8) * 8), np.uint8)
        words[:, :LENGTH] = rows[fit, BEFORE - i : BEFORE - i + LENGTH]
        a, b = np.zeros(len(fit), np.uint64), np.full(len(fit), 7, np.uint64)
        with np.errstate(over="ignore"):
            for w in words.view("<u8").T:
                a, b = common.mix(a * np.uint64(0x9E3779B97F4A7C15) + w), common.mix((b ^ w) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        one.append(a)
        two.append(b)
        fits.append(fit)
    a, b = np.concatenate(one), np.concatenate(two)
    by = np.lexsort((doc[np.concatenate(fits)], b, a))
    new = differs(by, a, b)
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(new) - 1
    cuts = np.cumsum([len(f) for f in fits])[:-1]
    return a[by[new]], b[by[new]], doc[np.concatenate(fits)][by[new]], list(zip(fits, np.split(which, cuts), strict=True))


def smallest_docs(rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """For distinct contexts, sorted by doc (within the groups of one seed, if given): the smallest document that has the
    string which starts i bytes before the seed, for i from 0 to BEFORE; NO_ID where the context has no such string."""
    n = len(rows)
    r_order, r_lcp = deep_shallow(rows[:, BEFORE:], group=group)
    l_order, l_lcp = deep_shallow(rows[:, BEFORE - 1 :: -1] if BEFORE else rows[:, :0], group=group)
    out = np.full((n, BEFORE + 1), C.NO_ID, np.int64)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(BEFORE + 1):
        fit = np.flatnonzero((left >= i) & (right >= LENGTH - i))
        if not len(fit):
            continue
        r_class[r_order] = np.cumsum(r_lcp < LENGTH - i)
        l_class[l_order] = np.cumsum(l_lcp < i) if i else 0
        _, first, inverse = np.unique(r_class[fit] * (n + 1) + l_class[fit], return_index=True, return_inverse=True)
        out[fit, i] = doc[fit][first][inverse]
    return out


def with_copies(docs: DataFrame, at_least: int = LENGTH) -> DataFrame:
    """doc_id, text and copy: whether the whole text, of 50 bytes or more, is that of a document with a smaller doc_id.
    Such a document goes as a whole and takes no part in the search. Its id is brought back by broadcast only if counted
    to be one of few."""
    long = docs.where(F.octet_length("text") >= at_least).select("doc_id", F.sha2("text", 256).alias("digest"))
    first = long.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = long.join(first, "digest").where("first < doc_id or (doc_id is null and first is not null)").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    copies = common.small_or_not(common.materialize(copies, "dedup-copies"), 128)
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.sha2(docs["text"], 256) == F.col("__digest"))
    return docs.join(copies, same, "left").select("doc_id", "text", F.col("__digest").isNotNull().alias("copy"))


def dedup(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, with_text: bool = False, hot_chunks: int = HOT_CHUNKS, hot_places: int = HOT_PLACES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every document: each byte
    inside a 50-byte string that also starts in a document with a smaller doc_id is removed.

    Null and empty texts have 0 bytes. Rows that repeat a doc_id don't remove from each other; a null doc_id is larger
    than all others. A doc_id is a whole number, as smaller ones come first; another type is an error. A text longer than
    a chunk has a chunk of its own. An empty table gives no rows; other columns are ignored."""
    C.whole_ids(docs)
    chunks = C.chunked(with_copies(docs), "dedup-chunks", chunk_bytes, "copy", note_places)
    shards = C.shards_for(C.raw_bytes(chunks), shard_bytes)

    def seed_requests(row: pd.Series) -> Iterator[tuple[int, int, bytes, bytes]]:
        *_, h, doc = noted_seeds(row)
        by = np.argsort(h, kind="stable")
        keys, first, n = np.unique(h[by], return_index=True, return_counts=True)
        several = doc[by][first] != doc[by][first + n - 1]  # seeds come in document order
        often = n > hot_places
        for shard, a, b in C.shard_bounds(keys, shards):
            yield shard, 0, C.pack_sorted(keys[a:b]), C.squeeze(np.packbits([several[a:b], often[a:b]], axis=1).tobytes())

    def seed_reply(kind: int, pdf: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
        keys = [C.unpack_sorted(b) for b in pdf["body"]]
        flags = [np.unpackbits(np.frombuffer(C.expand(b), np.uint8).reshape(2, -1), axis=1, count=len(k)) for b, k in zip(pdf["extra"], keys, strict=True)]
        several, often = np.concatenate(flags, axis=1)
        _, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = (n > 1) | (np.bincount(inverse, weights=several) > 0)
        hot = shared & ((n > hot_chunks) | (np.bincount(inverse, weights=often) > 0))
        a = 0
        for chunk, k in zip(pdf["chunk"], keys, strict=True):
            part = inverse[a : a + len(k)]
            yield chunk, C.squeeze(np.packbits([shared[part], hot[part]], axis=1).tobytes() + len(k).to_bytes(4, "little"))
            a += len(k)

    shared = C.answer(C.ask(chunks, seed_requests), seed_reply, "dedup-seeds")

    def distinct_contexts(row: pd.Series, got: list[bytes]):
        """ids, offsets, bytes; the shared seeds' places and documents, and which distinct context each has; the contexts
        in the order of their seeds' hashes, each with its smallest document; the same of hot seeds, see hot_strings()."""
        ids, at, raw, place, h, doc = noted_seeds(row)
        flags = []
        for b in map(C.expand, got):
            flags.append(np.unpackbits(np.frombuffer(b[:-4], np.uint8).reshape(2, -1), axis=1, count=int.from_bytes(b[-4:], "little")))
        keep, hot = (np.concatenate(flags, axis=1)[:, np.unique(h, return_inverse=True)[1]] > 0) if flags else np.zeros((2, len(h)), bool)
        burning = contexts(raw, at, place[hot], doc[hot])
        strings = (place[hot], doc[hot], *hot_strings(*burning, ids[doc[hot]]))
        keep &= ~hot
        place, h, doc = place[keep], h[keep], doc[keep]
        rows, left, right = contexts(raw, at, place, doc)
        whole = context_hash(rows, left, right)
        by = np.lexsort((ids[doc], whole, h))
        new = differs(by, h, whole, rows, left, right)
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        one = by[new]
        return ids, at, raw, place, doc, which, (h[one], rows[one], left[one], right[one], ids[doc[one]]), strings

    def context_rows(key: tuple, left_: pd.DataFrame, right_: pd.DataFrame) -> pd.DataFrame:
        common.lean()
        found = []
        if len(left_):
            *_, (h, rows, left, right, doc), (_, _, one, two, least, _) = distinct_contexts(left_.iloc[0], list(right_.sort_values("shard")["body"]))
            for shard, a, b in C.shard_bounds(h, shards):
                body = C.squeeze(np.ascontiguousarray(rows[a:b]))
                found.append((shard, 1, body, C.squeeze(doc[a:b].astype("<i8").tobytes() + left[a:b].tobytes() + right[a:b].tobytes())))
            for shard, a, b in C.shard_bounds(one, shards):
                found.append((shard, 2, C.pack_sorted(one[a:b]), C.squeeze(two[a:b].astype("<u8").tobytes() + least[a:b].astype("<i8").tobytes())))
        return C._rows(int(key[0]), iter(found))

    asked = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(context_rows, C.REQUEST)

    def string_reply(pdf: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
        keys = [C.unpack_sorted(b) for b in pdf["body"]]
        extra = [np.frombuffer(C.expand(b), "<u8").reshape(2, -1) for b in pdf["extra"]]
        one, two = np.concatenate(keys), np.concatenate([x[0] for x in extra])
        doc = np.concatenate([x[1] for x in extra]).view(np.int64)
        by = np.lexsort((doc, two, one))
        new = differs(by, one, two)
        least = np.empty(len(by), np.int64)
        least[by] = doc[by[new]][np.cumsum(new) - 1]
        a = 0
        for chunk, k in zip(pdf["chunk"], keys, strict=True):
            yield chunk, C.squeeze(least[a : a + len(k)].astype("<i8").tobytes())
            a += len(k)

    def context_reply(kind: int, pdf: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
        if kind == 2:
            yield from string_reply(pdf)
            return
        extra = [np.frombuffer(C.expand(b), np.uint8) for b in pdf["extra"]]
        sizes = np.array([len(x) // 10 for x in extra])
        doc = np.concatenate([x[: 8 * n].view("<i8") for x, n in zip(extra, sizes, strict=True)])
        left = np.concatenate([x[8 * n : 9 * n] for x, n in zip(extra, sizes, strict=True)])
        right = np.concatenate([x[9 * n :] for x, n in zip(extra, sizes, strict=True)])
        rows = np.concatenate([np.frombuffer(C.expand(b), np.uint8).reshape(-1, WIDTH) for b in pdf["body"]])
        chunk = pdf["chunk"].tolist()
        del extra, pdf
        whole = context_hash(rows, left, right)
        by = np.lexsort((doc, whole))
        new = differs(by, whole, rows, left, right)
        which = np.empty(len(by), np.int32)
        which[by] = np.cumsum(new) - 1
        one = by[new]
        rows, left, right, doc = rows[one], left[one], right[one], doc[one]
        del whole, by, new, one
        # contexts of one seed stand together, smaller documents first; a seed with a single context needs no sorting
        seed = row_hashes(rows[:, BEFORE : BEFORE + SEED])
        by = np.lexsort((doc, seed))
        seed = seed[by]
        tied = np.zeros(len(by), bool)
        tied[1:] = seed[1:] == seed[:-1]
        tied[:-1] |= tied[1:]
        fits = np.arange(BEFORE + 1)
        least = np.where((left[:, None] >= fits) & (right[:, None] >= LENGTH - fits), doc[:, None], C.NO_ID)
        many, own = by[tied], seed[tied]
        # a few groups at a time, so that only their rows are held twice
        cuts = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1))) if len(own) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(own))
        a = 0
        while a < len(cuts):
            b = max(a + 1, int(np.searchsorted(ends, cuts[a] + 20_000, side="right")))
            some = slice(cuts[a], ends[b - 1])
            at, group = many[some], np.cumsum(np.diff(own[some], prepend=own[some][:1]) != 0)
            least[at] = smallest_docs(rows[at], left[at], right[at], doc[at], group)
            a = b
        a = 0
        for c, size in zip(chunk, sizes.tolist(), strict=True):
            yield c, C.squeeze(np.ascontiguousarray(least[which[a : a + size]].T.astype("<i8")))
            a += size

    least = C.answer(asked, context_reply, "dedup-contexts")
    both = shared.where("chunk >= 0").unionByName(least)

    def removed(row: pd.Series, got: dict[int, list[bytes]]) -> pd.DataFrame:
        ids, at, raw, place, doc, which, _, (hot_place, hot_doc, one, _, _, strings) = distinct_contexts(row, got.get(0, []))
        cover = np.zeros(len(raw) + 1, np.int64)
        start = np.zeros(len(raw), bool)
        if len(place):
            table = np.concatenate([np.frombuffer(C.expand(b), "<i8").reshape(BEFORE + 1, -1) for b in got.get(1, [])], axis=1)
            for i in range(BEFORE + 1):
                start[place[table[i][which] < ids[doc]] - i] = True
        if len(one):
            known = np.concatenate([np.frombuffer(C.expand(b), "<i8") for b in got.get(2, [])])
            for i, (fit, string) in enumerate(strings):
                start[hot_place[fit[known[string] < ids[hot_doc[fit]]]] - i] = True
        hits = np.flatnonzero(start)
        cover[hits] += 1
        cover[hits + LENGTH] -= 1
        for d in np.flatnonzero(C.flags_of(row.meta)).tolist():
            cover[at[d]] += 1
            cover[at[d + 1]] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = at[:-1][at[:-1] < len(raw)]
        first[inner] = gone[inner]  # runs end with their documents
        up, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(first)])
        buf = np.frombuffer(raw, np.uint8)
        kept = [buf[a:b][~gone[a:b]].tobytes() if up[a] != up[b] else raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        out = pd.DataFrame({"doc_id": C.ids_out(ids), "n_bytes": np.diff(at), "n_removed": up[at[1:]] - up[at[:-1]], "n_spans": runs[at[1:]] - runs[at[:-1]], "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})
        return out.assign(kept=kept) if with_text else out

    return C.meet(chunks, both, removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    return dedup(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_array_dedup": op9_suffix_array_dedup}
ORACLES: dict[str, str] = {}
