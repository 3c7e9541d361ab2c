"""Alignment of two versions of a block list: unique-hash joins, similarity joins, moves, spines, edit scripts."""

from __future__ import annotations

import bisect
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.functions import text as T
from quirelake.sources.store import stored

#: Defaults of the alignment.
MIN_MOVE_WORDS, MOVE_SCORE, PAIR_SCORE, DISPLACEMENT = 3, 0.8, 0.35, 0.3


def unique_hash_join(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of blocks whose hash occurs exactly once in either version: key, hash, left_ord, right_ord."""
    once = lambda df, name: df.groupBy(key, "hash").agg(F.count("*").alias("n"), F.min("ord").alias(name)).where("n = 1").drop("n")
    return once(left, "left_ord").join(once(right, "right_ord"), [key, "hash"])


def crossing(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """pairs with moved: an earlier left block is paired with a later right one."""
    before = W.partitionBy(key).orderBy("left_ord").rowsBetween(W.unboundedPreceding, -1)
    return pairs.withColumn("moved", F.coalesce(F.max("right_ord").over(before) > F.col("right_ord"), F.lit(False)))


def residue(blocks: DataFrame, pairs: DataFrame, side: str, key: str = "doc_id") -> DataFrame:
    """Blocks of one side ("left" or "right") that no pair has."""
    return blocks.join(pairs.select(key, F.col(f"{side}_ord").alias("ord")), [key, "ord"], "left_anti")


def common_words(left: list[list[str]], right: list[list[str]], numbered: bool, least: float) -> Iterator[tuple]:
    """(left place, right places, words both have, left size, right sizes) of blocks, given as words, that share one and whose
    likeness is least or more: a block's words count as often as they occur, or once each if they aren't numbered.

    Right blocks are listed by word; a left block adds up the lists of its words. Memory is that of the words."""

    def members(words: list[str]) -> list:
        if not numbered:
            return list(dict.fromkeys(words))
        seen: Counter = Counter()
        out = []
        for w in words:
            out.append((w, seen[w]))
            seen[w] += 1
        return out

    ids: dict = {}
    own = [[ids.setdefault(m, len(ids)) for m in members(w)] for w in right]
    sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    flat = np.fromiter((x for o in own for x in o), dtype=np.int64, count=int(sizes.sum()))
    places = np.repeat(np.arange(len(own)), sizes)[np.argsort(flat, kind="stable")]
    ends = np.cumsum(np.bincount(flat, minlength=len(ids)))
    starts = np.concatenate([[0], ends[:-1]])
    for i, words in enumerate(left):
        mine = members(words)
        lists = [places[starts[x] : ends[x]] for x in (ids.get(m) for m in mine) if x is not None]
        if lists:
            both = np.bincount(np.concatenate(lists), minlength=len(own))
            # scores are rounded to six digits before they are held against a threshold
            at = np.flatnonzero((both > 0) & (both >= (least - 1e-6) * (len(mine) + sizes - both)))
            if len(at):
                yield i, at, both[at], len(mine), sizes[at]


def listed_words(blocks: DataFrame, within: list[str], name: str, least_words: int = 1) -> DataFrame:
    """within, <name>_ords, <name>_words: the blocks of so many words at least, one row for each value of within."""
    b = blocks.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("ord", T.words(F.col("text")).alias("w")))).alias("b"))
    b = b.withColumn("b", F.filter("b", lambda x: F.size(x["w"]) >= least_words))
    return b.select(*within, F.col("b.ord").alias(f"{name}_ords"), F.col("b.w").alias(f"{name}_words"))


def _similarity(left: DataFrame, right: DataFrame, key: str, within: list[str], numbered: bool, least: float, least_words: int) -> DataFrame:
    both = listed_words(left, within, "left", least_words).join(listed_words(right, within, "right", least_words), within)

    def run(frames):
        for pdf in frames:
            rows, n = [], 0
            for k, lo, lw, ro, rw in zip(pdf[key], pdf["left_ords"], pdf["left_words"], pdf["right_ords"], pdf["right_words"], strict=True):
                for i, at, shared, size, sizes in common_words(list(lw), list(rw), numbered, least):
                    rows.append((k, lo[i], np.asarray(ro)[at], shared, size, sizes))
                    n += len(at)
                    if n >= 100_000:
                        yield frame(rows)
                        rows, n = [], 0
            yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        n = [len(x[2]) for x in rows]
        flat = lambda c: np.concatenate([x[c] for x in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        one = lambda c: [x[c] for x, m in zip(rows, n, strict=True) for _ in range(m)]
        return pd.DataFrame({key: one(0), "left_ord": one(1), "right_ord": flat(2), "both": flat(3), "ls": one(4), "rs": flat(5)})

    met = both.select(key, "left_ords", "left_words", "right_ords", "right_words").mapInPandas(run, f"{key} {dict(left.dtypes)[key]}, left_ord long, right_ord long, both long, ls long, rs long")
    return met.select(key, "left_ord", "right_ord", F.round(F.col("both") / (F.col("ls") + F.col("rs") - F.col("both")), 6).alias("score"))


def bag_similarity(left: DataFrame, right: DataFrame, key: str = "doc_id", within: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """key, left_ord, right_ord, score of blocks that share a word and score least or more: sum of minima over the rest
    (multiset Jaccard). within: only blocks that these columns have alike meet, key by default; they are one row, and pairs
    below least, which a word that all blocks have would bring, never leave the kernel."""
    return _similarity(left, right, key, within or [key], True, least, 1).where(F.col("score") >= least)


def set_similarity(left: DataFrame, right: DataFrame, key: str = "doc_id", least_words: int = MIN_MOVE_WORDS, least: float = 0.0) -> DataFrame:
    """As bag_similarity, on sets of words, for blocks of at least so many words."""
    return _similarity(left, right, key, [key], False, least, least_words).where(F.col("score") >= least)


def mutual_best(scores: DataFrame, threshold: float, key: str = "doc_id") -> DataFrame:
    """Pairs that are each other's best; ties: the smallest left, then the smallest right."""
    s = scores.where(F.col("score") >= threshold)
    by = [F.col("score").desc(), "left_ord", "right_ord"]
    s = s.withColumn("a", F.row_number().over(W.partitionBy(key, "left_ord").orderBy(*by))).withColumn("b", F.row_number().over(W.partitionBy(key, "right_ord").orderBy(*by)))
    return s.where("a = 1 and b = 1").drop("a", "b")


def greedy_best_first(scores: DataFrame, threshold: float, key: str = "doc_id") -> DataFrame:
    """Repeatedly the best pair whose blocks are still free; ties: the smallest left, then the smallest right. The pairs
    of one document meet in one task; they are few, as only leftovers with a common word have a score."""

    def pick(rows: list) -> list[bool]:
        left, right, keep = set(), set(), []
        for _, a, b in rows:
            keep.append(a not in left and b not in right)
            if keep[-1]:
                left.add(a)
                right.add(b)
        return keep

    s = scores.where(F.col("score") >= threshold)
    return flagged(s, key, [(-F.col("score")).alias("least"), "left_ord", "right_ord"], pick, "free").where("free").select(*scores.columns)


def flagged(rows: DataFrame, key: str, order: list, flags, name: str) -> DataFrame:
    """rows with a boolean column that flags() gives for the rows of one key, as tuples of the columns in order, in that
    order. Keys travel as one row each in Arrow batches, which costs far less than a group each where groups are small; only
    the columns in order become objects of Python."""
    rest = [c for c in rows.columns if c != key]
    n = len(order)
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row")))).alias("rows"))

    def run(batches):
        for batch in batches:
            own = batch.column("rows")
            flat = own.flatten()
            ordered = list(zip(*[pc.struct_field(flat, f"o{i}").to_pylist() for i in range(n)], strict=True))
            ends = np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False)).tolist()
            found = [flags(ordered[i:j]) for i, j in itertools.pairwise([0, *ends])]
            yield pa.RecordBatch.from_arrays([batch.column(key), own, pa.array(found, pa.list_(pa.bool_()))], names=[key, "rows", "flags"])

    kind = f"array<{listed.schema['rows'].dataType.elementType.simpleString()}>"
    out = listed.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, rows {kind}, flags array<boolean>")
    out = out.select(key, F.explode(F.arrays_zip("rows", "flags")).alias("x")).select(key, "x.rows.row.*", F.col("x.flags").alias(name))
    return out.select(*rows.columns, name)


def lis_flags(values: list) -> list[bool]:
    """Which members belong to one longest strictly increasing subsequence (patience sorting, the earliest links)."""
    tails, at, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    keep = [False] * len(values)
    i = at[-1] if at else -1
    while i >= 0:
        keep[i], i = True, back[i]
    return keep


def weighted_lis_flags(values: list, weights: list) -> list[bool]:
    """The same with the largest total weight, by a Fenwick tree of prefix maxima; ties keep the earlier chain."""
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(values)))}
    best = [(0, -1)] * (len(ranks) + 1)
    back, total = [], []
    for i, v in enumerate(values):
        top, k = (0, -1), ranks[v] - 1
        while k:
            if best[k][0] > top[0]:
                top = best[k]
            k -= k & -k
        total.append(top[0] + weights[i])
        back.append(top[1])
        k = ranks[v]
        while k < len(best):
            if total[i] > best[k][0]:
                best[k] = (total[i], i)
            k += k & -k
    keep = [False] * len(values)
    i = int(np.argmax(total)) if total else -1
    while i >= 0:
        keep[i], i = True, back[i]
    return keep


def spine(pairs: DataFrame, key: str = "doc_id", weight: str | None = None) -> DataFrame:
    """pairs with on_spine: whether the pair is on the longest in-order chain of its document."""

    if weight:
        return flagged(pairs, key, ["left_ord", "right_ord", weight], lambda rows: weighted_lis_flags([r[1] for r in rows], [r[2] for r in rows]), "on_spine")
    return flagged(pairs, key, ["left_ord", "right_ord"], lambda rows: lis_flags([r[1] for r in rows]), "on_spine")


def spine_gaps(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs in left order with gap_id, the number of pairs that come before."""
    return pairs.withColumn("gap_id", (F.row_number().over(W.partitionBy(key).orderBy("left_ord")) - 1).cast("long"))


def gaps(blocks: DataFrame, anchors: DataFrame, side: str, key: str = "doc_id") -> DataFrame:
    """Blocks that no anchor has, with gap: how many anchors on the spine come before. One window over a document."""
    return beside_spine(blocks, anchors, side, key).where("not moved").drop("moved")


def beside_spine(blocks: DataFrame, anchors: DataFrame, side: str, key: str = "doc_id") -> DataFrame:
    """Blocks that no anchor on the spine has, with gap, and moved: whether one off the spine has it."""
    a = anchors.select(key, F.col(f"{side}_ord").alias("ord"), F.col("on_spine").cast("long").alias("step"))
    before = W.partitionBy(key).orderBy("ord", F.col("step").isNull()).rowsBetween(W.unboundedPreceding, 0)
    # anchors are rows in front of their blocks, so blocks are shuffled once, by document, and not joined
    rows = blocks.withColumn("step", F.lit(None).cast("long")).unionByName(a, allowMissingColumns=True)
    rows = rows.withColumn("gap", F.sum(F.coalesce("step", F.lit(0))).over(before)).withColumn("anchor", F.last(F.when(F.col("step").isNotNull(), F.col("ord")), ignorenulls=True).over(before))
    rows = rows.withColumn("spine", F.last("step", ignorenulls=True).over(before)).withColumn("moved", F.col("anchor").eqNullSafe(F.col("ord")))
    return rows.where("step is null and not (moved and spine = 1)").drop("step", "anchor", "spine")


def numbered_bag(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, bag: the words of a block as a set, the n-th occurrence of a word as a member of its own."""
    w = blocks.select(key, "ord", F.explode(T.words(F.col("text"))).alias("w")).groupBy(key, "ord", "w").agg(F.count("*").alias("n"))
    w = w.select(key, "ord", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat_ws("\x1f", "w", i.cast("string")))).alias("member"))
    return w.groupBy(key, "ord").agg(F.collect_list("member").alias("bag"))


def near_moves(left: DataFrame, right: DataFrame, key: str = "doc_id", least: float = MOVE_SCORE, words: int = MIN_MOVE_WORDS) -> DataFrame:
    """key, left_ord, right_ord, score of leftover blocks (of so many words at least) whose bags are alike enough.

    Alike blocks share one of their rarest members: of n, all but a share of least, and one more. Only these are joined, so
    a word that all blocks of a document have brings no pairs."""
    bags_ = numbered_bag(left.withColumn("__side", F.lit(0)), key).withColumn("side", F.lit(0)).unionByName(numbered_bag(right, key).withColumn("side", F.lit(1))).where(F.size("bag") >= words)
    bags_ = stored(bags_, "bags")
    members = bags_.select(key, "side", "ord", F.size("bag").alias("n"), F.explode("bag").alias("member"))
    rare = members.withColumn("df", F.count("*").over(W.partitionBy(key, "member")))
    rare = rare.withColumn("rank", F.row_number().over(W.partitionBy(key, "side", "ord").orderBy("df", "member"))).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    l, r = (rare.where(F.col("side") == s).select(key, "member", F.col("ord").alias(f"{name}_ord"), F.col("n").alias(f"{name}_n")) for s, name in ((0, "left"), (1, "right")))
    met = l.join(r, [key, "member"]).where((F.col("left_n") * least <= F.col("right_n")) & (F.col("right_n") * least <= F.col("left_n"))).select(key, "left_ord", "right_ord").distinct()
    bag = lambda s, name: bags_.where(F.col("side") == s).select(key, F.col("ord").alias(f"{name}_ord"), F.col("bag").alias(f"{name}_bag"))
    met = met.join(bag(0, "left"), [key, "left_ord"]).join(bag(1, "right"), [key, "right_ord"])
    both = F.size(F.array_intersect("left_bag", "right_bag"))
    return met.select(key, "left_ord", "right_ord", F.round(both / (F.size("left_bag") + F.size("right_bag") - both), 6).alias("score")).where(F.col("score") >= least)


def edit_script(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, seq, op, left_ord, right_ord, left_text, right_text that turns left into right.

    Unique equal blocks on the spine are Equal, off it Move; leftovers in one gap that are alike enough are Modify (greedy,
    best first); leftovers of three words or more anywhere that are nearly equal are MoveModify; the rest is
    Delete or Insert. seq follows the right side; a deletion follows the block before it."""
    one = lambda df, name: stored(df.select(key, "ord", "text", "hash").withColumn("row", F.monotonically_increasing_id()), name)
    left, right = one(left, "left-blocks"), one(right, "right-blocks")
    anchored = stored(spine(unique_hash_join(left, right, key).select(key, "left_ord", "right_ord"), key), "anchors")
    beside = [stored(beside_spine(df.select(key, "ord", "text", "row"), anchored, side, key), f"{side}-rest") for df, side in ((left, "left"), (right, "right"))]
    gl, gr = (df.where("not moved").select(key, "ord", "text", "gap") for df in beside)
    scores = bag_similarity(gl, gr, key, [key, "gap"], PAIR_SCORE)
    modified = greedy_best_first(scores.select(key, "left_ord", "right_ord", "score"), PAIR_SCORE, key)
    modified = stored(spine(modified.select(key, "left_ord", "right_ord"), key).where("on_spine").select(key, "left_ord", "right_ord", F.lit("Modify").alias("op")), "modified")
    moves = near_moves(residue(gl, modified, "left", key), residue(gr, modified, "right", key), key)
    moved = greedy_best_first(moves, MOVE_SCORE, key).select(key, "left_ord", "right_ord", F.lit("MoveModify").alias("op"))
    pairs = anchored.select(key, "left_ord", "right_ord", F.when(F.col("on_spine"), "Equal").otherwise("Move").alias("op")).unionByName(modified).unionByName(moved)
    # the script is made of places; texts are joined to it at the end by the row that they were stored as: of blocks beside
    # the spine, which are few, and of equal ones from one side only, which readers of changes never ask for
    l, r = (df.select(key, F.col("ord").alias(f"{side}_ord"), F.col("row").alias(f"{side}_row")) for df, side in ((left, "left"), (right, "right")))
    script = l.join(pairs, [key, "left_ord"], "left").join(r, [key, "right_ord"], "full").withColumn("op", F.when(F.col("left_ord").isNull(), "Insert").when(F.col("right_ord").isNull(), "Delete").otherwise(F.col("op")))
    last_right = F.last(F.when(F.col("op").isin("Equal", "Modify"), F.col("right_ord")), ignorenulls=True).over(W.partitionBy(key).orderBy(F.col("left_ord").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    script = script.withColumn("at", F.coalesce("right_ord", F.when(F.col("left_ord").isNotNull(), last_right), F.lit(-1)))
    order = W.partitionBy(key).orderBy("at", F.col("right_ord").isNull(), "left_ord")
    script = stored(script.select(key, (F.row_number().over(order) - 1).cast("long").alias("seq"), "op", "left_ord", "right_ord", "left_row", "right_row"), "script")

    def with_text(rows: DataFrame, blocks: DataFrame, side: str) -> DataFrame:
        texts = blocks.select(F.col(key).alias("__key"), F.col("row").alias("__row"), F.col("text").alias(f"{side}_text"))
        return rows.join(texts, F.col(key).eqNullSafe(F.col("__key")) & (F.col(f"{side}_row") == F.col("__row")), "left").drop("__key", "__row")

    columns = [key, "seq", "op", "left_ord", "right_ord", "left_text", "right_text"]
    same = with_text(script.where("op = 'Equal'").withColumn("op", F.lit("Equal")), left, "left").withColumn("right_text", F.col("left_text"))
    rest = with_text(with_text(script.where("op <> 'Equal'"), beside[0], "left"), beside[1], "right")
    return same.select(*columns).unionByName(rest.select(*columns))


def block_script(left_texts: list, left_hashes: list, right_texts: list, right_hashes: list) -> list[tuple[str, int | None, int | None]]:
    """(op, left place, right place) of edit_script in its order, for two versions whose blocks are given in order: for texts
    that are at hand already, so that nothing is shuffled for a version."""
    ours, theirs = ({h: i for i, h in enumerate(hashes) if h is not None and n[h] == 1} for hashes, n in ((x, Counter(x)) for x in (left_hashes, right_hashes)))
    pairs = sorted((i, theirs[h]) for h, i in ours.items() if h in theirs)
    found = {i: ("Equal" if on else "Move", j) for (i, j), on in zip(pairs, lis_flags([j for _, j in pairs]), strict=True)}
    fixed = {i for i, _ in pairs}, {j for _, j in pairs}
    words: tuple[dict, dict] = {}, {}

    def cut(side: int, at: list[int]) -> list[list[str]]:
        texts, own = (left_texts, right_texts)[side], words[side]
        for i in at:
            if i not in own:
                own[i] = T.word_list(texts[i])
        return [own[i] for i in at]

    def alike(a: list[int], b: list[int], least: float) -> list[tuple[int, int, int]]:
        """(- score in millionths, left place, right place): scores are rounded to six digits."""
        out = []
        for x, at, both, size, sizes in common_words(cut(0, a), cut(1, b), True, least) if a and b else ():
            rest = size + sizes - both
            score = (2_000_000 * both + rest) // (2 * rest)
            out += [(-s, a[x], b[y]) for y, s in zip(at.tolist(), score.tolist(), strict=True) if s >= round(least * 1_000_000)]
        return out

    def best_first(scores: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        out, left, right = [], set(), set()
        for _, i, j in sorted(scores):
            if i not in left and j not in right:
                left.add(i), right.add(j), out.append((i, j))
        return sorted(out)

    scores, free = [], ([], [])
    for (i, j), (k, m) in itertools.pairwise([(-1, -1), *((i, j) for i, (op, j) in sorted(found.items()) if op == "Equal"), (len(left_texts), len(right_texts))]):
        gap = [x for x in range(i + 1, k) if x not in fixed[0]], [y for y in range(j + 1, m) if y not in fixed[1]]
        scores += alike(*gap, PAIR_SCORE)
        free[0].extend(gap[0]), free[1].extend(gap[1])
    modified = best_first(scores)
    modified = [p for p, on in zip(modified, lis_flags([j for _, j in modified]), strict=True) if on]
    found |= {i: ("Modify", j) for i, j in modified}
    used = {j for _, j in modified}
    rest = [i for i in free[0] if i not in found], [j for j in free[1] if j not in used]
    if all(rest):
        rest = tuple([x for x, w in zip(at, cut(side, at), strict=True) if len(w) >= MIN_MOVE_WORDS] for side, at in enumerate(rest))
        found |= {i: ("MoveModify", j) for i, j in best_first(alike(*rest, MOVE_SCORE))}
    rows, last = [], -1
    for i in range(len(left_texts)):
        op, j = found.get(i, ("Delete", None))
        if op in ("Equal", "Modify"):
            last = j
        rows.append((last if j is None else j, j is None, i, op, j))
    taken = {j for _, j in found.values()}
    rows += [(j, False, None, "Insert", j) for j in range(len(right_texts)) if j not in taken]
    return [(op, i, j) for _, _, i, op, j in sorted(rows, key=lambda x: x[:2] + (-1 if x[2] is None else x[2],))]


def accepted(script: DataFrame, key: str = "doc_id") -> DataFrame:
    """The right version: key, ord, text."""
    s = script.where("op <> 'Delete'")
    return s.select(key, (F.row_number().over(W.partitionBy(key).orderBy("right_ord")) - 1).cast("long").alias("ord"), F.col("right_text").alias("text"))


def rejected(script: DataFrame, key: str = "doc_id") -> DataFrame:
    """The left version."""
    s = script.where("op <> 'Insert'")
    return s.select(key, (F.row_number().over(W.partitionBy(key).orderBy("left_ord")) - 1).cast("long").alias("ord"), F.col("left_text").alias("text"))


def revisions(script: DataFrame, key: str = "doc_id") -> DataFrame:
    """The script's changes as revisions: key, seq, kind, text, move_group (both halves of a move have one)."""
    moves = F.when(F.col("op").isin("Move", "MoveModify"), F.row_number().over(W.partitionBy(key, F.col("op").isin("Move", "MoveModify")).orderBy("seq")))
    rows = script.where("op <> 'Equal'").withColumn("move_group", moves.cast("long"))
    parts = F.when(F.col("op") == "Insert", F.array(F.struct(F.lit("Inserted").alias("kind"), F.col("right_text").alias("text")))).when(
        F.col("op") == "Delete", F.array(F.struct(F.lit("Deleted").alias("kind"), F.col("left_text").alias("text")))).when(
        F.col("op") == "Modify", F.array(F.struct(F.lit("Deleted").alias("kind"), F.col("left_text").alias("text")), F.struct(F.lit("Inserted").alias("kind"), F.col("right_text").alias("text")))).otherwise(
        F.array(F.struct(F.lit("MovedFrom").alias("kind"), F.col("left_text").alias("text")), F.struct(F.lit("MovedTo").alias("kind"), F.col("right_text").alias("text"))))
    return rows.select(key, "seq", F.posexplode(parts).alias("part", "r"), "move_group").select(key, "seq", F.col("part").cast("long").alias("part"), "r.kind", "r.text", "move_group")


# Token diff ------------------------------------------------------------------------------------------------------------


def myers(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of equal members on a shortest edit path (greedy O(ND) search, furthest reaching paths kept)."""
    n, m = len(a), len(b)
    if a == b:
        return [(i, i) for i in range(n)]
    head = 0
    while head < n and head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    reach, trace = {1: 0}, []
    done = not x and not y
    for d in range(len(x) + len(y) + 1):
        if done:
            break
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            i = reach.get(k + 1, -1) if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach.get(k - 1, -1) + 1
            j = i - k
            while i < len(x) and j < len(y) and x[i] == y[j]:
                i, j = i + 1, j + 1
            reach[k] = i
            if i >= len(x) and j >= len(y):
                done = True
                break
    pairs, i, j = [], len(x), len(y)
    for d in range(len(trace) - 1, -1, -1):
        v, k = trace[d], i - j
        prev = k + 1 if k == -d or (k != d and v.get(k - 1, -1) < v.get(k + 1, -1)) else k - 1
        pi = v.get(prev, 0)
        pj = pi - prev
        while i > pi and j > pj and i > 0 and j > 0 and (d == 0 or (i, j) != (pi + (prev == k - 1), pj + (prev == k + 1))):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        i, j = (pi, pj) if d else (i, j)
    pairs = [(p + head, q + head) for p, q in reversed(pairs)]
    return [(i, i) for i in range(head)] + pairs + [(n - tail + i, m - tail + i) for i in range(tail)]


def diff_spans(a: list[str], b: list[str]) -> list[tuple[str, str, str]]:
    """(op, left, right) spans: words are anchored first, separators only between equal words; then runs are joined."""
    word = lambda t: t.isalnum() or (len(t) > 1 and any(c.isalnum() for c in t))
    ia, ib = [i for i, t in enumerate(a) if word(t)], [i for i, t in enumerate(b) if word(t)]
    anchors = [(ia[i], ib[j]) for i, j in myers([a[i].lower() for i in ia], [b[i].lower() for i in ib])] if ia or ib else []
    equal, i, j = [], 0, 0
    for p, q in [*anchors, (len(a), len(b))]:
        if p - i == 1 == q - j:
            equal += [(i, j)] if a[i] == b[j] else []
        elif p > i and q > j:
            equal += [(i + u, j + v) for u, v in myers(a[i:p], b[j:q])]
        if p < len(a):
            equal.append((p, q))
        i, j = p + 1, q + 1
    out, i, j = [], 0, 0
    for p, q in [*equal, (len(a), len(b))]:
        if i < p:
            out.append(("Delete", "".join(a[i:p]), ""))
        if j < q:
            out.append(("Insert", "", "".join(b[j:q])))
        if p < len(a):
            if out and out[-1][0] == "Equal":
                out[-1] = ("Equal", out[-1][1] + a[p], out[-1][2] + b[q])
            else:
                out.append(("Equal", a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def token_diff(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, span, op, left, right for pairs of texts (left_text, right_text)."""
    cut = pairs.select(*keys, T.tokens(F.col("left_text")).alias("a"), T.tokens(F.col("right_text")).alias("b"))

    def run(it):
        for pdf in it:
            spans = [diff_spans(list(a), list(b)) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            n = [len(s) for s in spans]
            flat = [x for s in spans for x in s]
            out = {k: np.repeat(pdf[k].to_numpy(), n) for k in keys}
            yield pd.DataFrame({**out, "span": [i for k in n for i in range(k)], "op": [x[0] for x in flat], "left": [x[1] for x in flat], "right": [x[2] for x in flat]})

    kinds = dict(pairs.dtypes)
    return cut.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", span long, op string, left string, right string")
