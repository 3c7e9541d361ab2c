"""Edit scripts with all kinds of operations: besides equal, moved, modified, inserted and deleted blocks also blocks that
change their format only, that are split or merged, and runs whose words cross the boundary between two blocks.

Spark anchors equal blocks, cuts what is left into gaps and finds moves; one small kernel per gap picks the best chain of
pairs, splits and merges."""

from __future__ import annotations

import bisect
import itertools
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.functions import text as T
from quirelake.operators import align
from quirelake.sources.store import stored

#: A split's least share of the whole that its parts hold, in order; the greatest share of the parts that the
#: whole doesn't hold; the least share if text was added; the longest run of parts.
COVERAGE, FOREIGN, ADDED, LONGEST = 0.9, 0.34, 0.3, 8
#: Cells of a table of a common subsequence that are kept at once; of a larger one, parts are made again.
KEPT_CELLS = 1_000_000


# Kernels of one gap ---------------------------------------------------------------------------------------------------


def candidates(left: list[list[str]], right: list[list[str]], singular: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(first left, last left, first right, last right, weight) of pairs, splits and merges of blocks, given as words.

    Weights are matched words, times a thousand, less the blocks they use. Blocks meet over shared words only."""
    met = list(align.common_words(left, right, True, 0.0))
    out = []
    for i, at, both, size, sizes in met:
        alike = both >= align.PAIR_SCORE * (size + sizes - both)
        out += [(i, i, j, j, 1000 * n - 2) for j, n in zip(at[alike].tolist(), both[alike].tolist(), strict=True)]
    out += [(i, i, a, b, w) for i, a, b, w in runs(left, right, met)]
    out += [(a, b, j, j, w) for j, a, b, w in runs(right, left)]
    return out


def runs(whole: list[list[str]], parts: list[list[str]], met: list | None = None) -> list[tuple[int, int, int, int]]:
    """(whole, first part, last part, weight) of blocks and the runs of two to eight others that they may be cut into: the
    words of the run stand in the block in order, enough of either side, and two or more in each part at an end. met: what
    common_words finds of them. A run has at most the words that its parts have one by one, and the block's, so only one that may have
    enough, with a fit part at both ends, is looked at, and its words are counted as it grows."""
    out = []
    bags: dict[int, Counter] = {}
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    until = np.concatenate([[0], np.cumsum(lengths)])
    for i, at, met_words, _, sizes in met or align.common_words(whole, parts, True, 0.0):
        words = whole[i]
        fits = (met_words >= 2) & (sizes - met_words <= FOREIGN * np.maximum(sizes, len(words)))
        starts = at[fits]
        if len(starts) < 2:
            continue
        most, last = np.zeros(len(parts) + 1, np.int64), np.zeros(len(parts) + LONGEST, bool)
        most[at + 1], last[starts] = met_words, True
        most = np.cumsum(most)
        b = starts[:, None] + np.arange(1, LONGEST)
        after = np.minimum(b, len(parts) - 1) + 1
        met_all, every = np.minimum(most[after] - most[starts, None], len(words)), until[after] - until[starts, None]
        grows = np.logical_and.accumulate(every - met_all <= FOREIGN * np.maximum(every, len(words)), axis=1)
        enough = (grows & last[b] & (met_all >= ADDED * len(words)) & (every - met_all <= FOREIGN * every)).any(axis=1)
        own = Counter(words) if enough.any() else None
        for a in starts[enough].tolist():
            got: Counter = Counter()
            total = both = 0
            for b in range(a, min(len(parts), a + LONGEST)):
                if b not in bags:
                    bags[b] = Counter(parts[b])
                total += len(parts[b])
                small, large = (bags[b], own) if len(bags[b]) < len(own) else (own, bags[b])
                for w in small:
                    if w in large:
                        both += min(own[w], got[w] + bags[b][w]) - min(own[w], got[w])
                        got[w] += bags[b][w]
                if b == a:
                    continue
                if total - both > FOREIGN * max(total, len(words)):
                    break
                if last[b] and both >= ADDED * len(words) and total - both <= FOREIGN * total:
                    flat = [(j, w) for j in range(a, b + 1) for w in parts[j]]
                    matched = align.myers(words, [w for _, w in flat])
                    per_part = Counter(flat[q][0] for _, q in matched)
                    two = [per_part[j] >= 2 for j in range(a, b + 1)]
                    whole_enough = len(matched) >= COVERAGE * len(words) and sum(two) >= 2
                    added = len(matched) >= ADDED * len(words) and all(two)
                    if two[0] and two[-1] and len(flat) - len(matched) <= FOREIGN * len(flat) and (whole_enough or added):
                        out.append((i, a, b, 1000 * len(matched) - (b - a + 2)))
    return out


def best_chain(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The candidates of the greatest total weight that use each block once and keep both orders: a sweep over the left
    side with the best totals by right end (a staircase: both ends and totals grow)."""
    found = sorted(found)
    closing = sorted(range(len(found)), key=lambda k: found[k][1])
    ends, totals, last = [-1], [0], [-1]
    total, back, c = [0] * len(found), [-1] * len(found), 0
    for k, (first, _, lo, _, weight) in enumerate(found):
        while c < len(found) and found[closing[c]][1] < first:
            done, c = closing[c], c + 1
            end = found[done][3]
            at = bisect.bisect_right(ends, end)
            if totals[at - 1] < total[done]:
                if ends[at - 1] == end:
                    totals[at - 1], last[at - 1] = total[done], done
                else:
                    ends.insert(at, end), totals.insert(at, total[done]), last.insert(at, done)
                    at += 1
                while at < len(ends) and totals[at] <= total[done]:
                    del ends[at], totals[at], last[at]
        at = bisect.bisect_left(ends, lo) - 1
        total[k], back[k] = totals[at] + weight, last[at]
    k = max(range(len(found)), key=lambda k: (total[k], -k), default=-1)
    out = []
    while k >= 0:
        out.append(found[k])
        k = back[k]
    return out[::-1]


def heaviest(left: list[list[str]], right: list[list[str]]) -> list[tuple[int, int]]:
    """Places, over all blocks of a side, of the common subsequence of paired blocks with the most characters matched within
    the pairs, and of these with the most matched across boundaries. Ties keep the right side's earlier places free.

    What crosses a pair with a word of its own would lose that word, so a block meets the right ones from the pair before it
    to the one after it that have words in common. Rows of the table are kept where blocks begin, and made again, a part at a
    time, where the way leads through them: memory grows with the words, not with the cells."""
    ids: dict[str, int] = {}
    code = lambda side: [np.fromiter((ids.setdefault(w, len(ids)) for w in block), dtype=np.int64, count=len(block)) for block in side]
    l, r = code(left), code(right)
    weights = np.fromiter((max(1, len(w)) for w in ids), dtype=np.int64, count=len(ids))
    n = len(l)
    own = [k for k in range(n) if np.intersect1d(l[k], r[k]).size]
    flat, begins = np.concatenate([*r, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in r])])
    most = 1 + sum(int(weights[x].sum()) for x in l)

    def window(k: int) -> tuple[int, int]:
        at, behind = bisect.bisect_left(own, k), bisect.bisect_right(own, k)
        return int(begins[own[at - 1]]) if at else 0, int(begins[own[behind] + 1]) if behind < len(own) else len(flat)

    class Block:
        """The rows of one left block: a row is the best of what is left from there, by right place."""

        def __init__(self, k: int):
            self.words, (self.lo, self.hi) = l[k], window(k)
            self.gain = weights[flat[self.lo : self.hi]]
            inside = slice(int(begins[k]) - self.lo, int(begins[k + 1]) - self.lo)
            self.gain[inside] *= most
            wanted = flat[self.lo : self.hi]
            order = np.argsort(wanted, kind="stable")
            ranks = wanted[order]
            self.places = {int(w): order[np.searchsorted(ranks, w) : np.searchsorted(ranks, w, "right")] for w in np.unique(self.words)}

        def above(self, i: int, below: np.ndarray) -> np.ndarray:
            at = self.places[int(self.words[i])]
            if not len(at):
                return below
            row = below.copy()
            row[at] = np.maximum(below[at], below[at + 1] + self.gain[at])
            return np.maximum.accumulate(row[::-1])[::-1]

        def way(self, first: int, last: int, below: np.ndarray, j: int, found: list, base: int) -> int:
            """Where the best way from that row and place leaves the rows; its matches go to found."""
            if last - first > 1 and (last - first) * len(below) > KEPT_CELLS:
                size = max(1, -(-(last - first) // 16))
                starts = list(range(first, last, size))
                rows = [below]
                for start, end in reversed(list(zip(starts[1:], [*starts[2:], last], strict=True))):
                    row = rows[-1]
                    for i in reversed(range(start, end)):
                        row = self.above(i, row)
                    rows.append(row)
                for start, end in zip(starts, [*starts[1:], last], strict=True):
                    j = self.way(start, end, rows.pop(), j, found, base)
                return j
            rows = [below]
            for i in reversed(range(first, last)):
                rows.append(self.above(i, rows[-1]))
            for i in range(first, last):
                here, under = rows.pop(), rows[-1]
                while True:
                    if j < self.hi - self.lo and flat[self.lo + j] == self.words[i] and here[j] == under[j + 1] + self.gain[j]:
                        found.append((base + i, self.lo + j))
                        j += 1
                        break
                    if here[j] == under[j]:
                        break
                    j += 1
            return j

    def under(k: int, row: np.ndarray, rlo: int) -> np.ndarray:
        """The row of the next block on the places of this one: what lies before its own has the best of all of it."""
        lo, hi = window(k)
        return np.concatenate([np.full(max(0, min(rlo, hi + 1) - lo), row[0]), row[max(0, lo - rlo) : max(0, hi + 1 - rlo)]])

    rows = [None] * n + [(np.zeros(1, np.int64), len(flat))]
    for k in reversed(range(n)):
        block = Block(k)
        row = under(k, *rows[k + 1])
        for i in reversed(range(len(block.words))):
            row = block.above(i, row)
        rows[k] = (row, block.lo)
    out: list[tuple[int, int]] = []
    j = base = 0
    for k in range(n):
        block = Block(k)
        j = block.lo + block.way(0, len(block.words), under(k, *rows[k + 1]), max(0, j - block.lo), out, base)
        base += len(block.words)
    return out


def crossed(left: list[list[str]], right: list[list[str]]) -> list[dict] | None:
    """Cells of a run of pairs of blocks, given as tokens, if words of one pair are found in the next; else None.

    Words are matched within each pair first, and of the ways to do so the one is taken that leaves most to be matched across
    the boundaries. A boundary is kept if as many matches come before it on either side, the last one always; else it is one
    that was inserted and one that was deleted. Between two matches new text comes before old."""
    flat = [[(k, t) for k, block in enumerate(side) for t in block] for side in (left, right)]
    word = lambda t: any(c.isalnum() for c in t)
    places = [[i for i, (_, t) in enumerate(f) if word(t)] for f in flat]
    every = [(places[0][p], places[1][q]) for p, q in heaviest(*([[t.lower() for t in block if word(t)] for block in side] for side in (left, right)))]
    crossing = sum(flat[0][p][0] != flat[1][q][0] for p, q in every)
    if not crossing:
        return None
    ends = [list(itertools.accumulate(map(len, side))) for side in (left, right)]
    before = [[bisect.bisect_left(m, end) for end in e] for m, e in zip(zip(*every, strict=True), ends, strict=True)]
    kept = [k == len(left) - 1 or before[0][k] == before[1][k] for k in range(len(left))]
    # both streams with their boundaries: token places count the boundaries before them
    stream = [[x for k, block in enumerate(side) for x in [*block, None]] for side in (left, right)]
    met = sorted([(p + flat[0][p][0], q + flat[1][q][0]) for p, q in every] + [(ends[0][k] + k, ends[1][k] + k) for k in range(len(left)) if kept[k]])
    cells, cell, i, j = [], ["", ""], 0, 0

    def close(mark):
        cells.append({"left": cell[0], "right": cell[1], "mark": mark})
        cell[:] = ["", ""]

    for x, y in met:
        for side, here, until, mark in ((1, j, y, "Inserted"), (0, i, x, "Deleted")):
            for t in stream[side][here:until]:
                if t is None:
                    close(mark)
                else:
                    cell[side] += t
        if stream[0][x] is None:
            close("Equal")
        else:
            cell[0], cell[1] = cell[0] + stream[0][x], cell[1] + stream[1][y]
        i, j = x + 1, y + 1
    return cells


def gap_operations(left: list[str], right: list[str], lt: list[list[str]], rt: list[list[str]]) -> list[dict]:
    """Operations of one gap on places of its blocks: their texts and tokens are given in order."""
    words = lambda side: [[t.lower() for t in block if any(c.isalnum() for c in t)] for block in side]
    chain = best_chain(candidates(words(lt), words(rt), left))
    out, k = [], 0
    while k < len(chain):
        a, b, c, d, _ = chain[k]
        n = k
        if a == b and c == d:
            while n + 1 < len(chain) and chain[n + 1][:4] == (a + n + 1 - k, a + n + 1 - k, c + n + 1 - k, c + n + 1 - k):
                n += 1
            # nothing crosses a pair of equal blocks, whose words are all matched: it ends a run
            same = [list(lt[x[0]]) == list(rt[x[2]]) for x in chain[k : n + 1]]
            for equal, group in itertools.groupby(range(n + 1 - k), lambda i: same[i]):
                group = list(group)
                u, v, w = group[0], group[-1] + 1, len(group)
                cells = crossed([list(x) for x in lt[a + u : a + v]], [list(x) for x in rt[c + u : c + v]]) if w > 1 and not equal else None
                if cells:
                    out.append({"op": "CrossParagraphRun", "left": list(range(a + u, a + v)), "right": list(range(c + u, c + v)), "cells": cells})
                else:
                    out += [{"op": "Modify", "left": [x[0]], "right": [x[2]], "cells": None} for x in chain[k + u : k + v]]
        else:
            out.append({"op": "Split" if a == b else "Merge", "left": list(range(a, b + 1)), "right": list(range(c, d + 1)), "cells": None})
        k = n + 1
    return out


# The script -----------------------------------------------------------------------------------------------------------

OPERATIONS = "op string, left_ords array<long>, right_ords array<long>, cells array<struct<left:string,right:string,mark:string>>"


def full_script(left: DataFrame, right: DataFrame, key: str = "doc_id", texts: bool = True) -> DataFrame:
    """key, seq, op, left_ords, right_ords, left_texts, right_texts, cells that turn left into right.

    left and right hold key, ord, text, hash, and format if formats are compared. Blocks with equal hashes that are unique in
    both versions are Equal on the spine and Move off it (FormatOnly if their formats differ). What is left between two
    anchors of the spine is a gap; in it the chain of Modify, Split and Merge with the most matched words is taken, each
    block once. Neighbouring modifications with words that cross their boundary are one CrossParagraphRun. Leftovers
    anywhere in the document that are nearly equal are MoveModify; the rest is Delete or Insert. seq follows the right side; a
    deletion follows the block before it. Gaps of a document are rows of their own, so only one gap is in memory at once.
    Blocks with equal hashes have equal texts. texts: with left_texts and right_texts, for which all texts are shuffled."""
    fields = ["ord", "text", "hash", *(["format"] if "format" in left.columns else [])]
    left, right = stored(left.select(key, *fields), "left-blocks"), stored(right.select(key, *fields), "right-blocks")
    short = lambda df: df.withColumn("hash", F.unhex(F.sha2("hash", 256)))
    anchors = stored(align.spine(align.unique_hash_join(short(left), short(right), key).select(key, "left_ord", "right_ord"), key), "anchors")
    rest_l, rest_r = (stored(align.gaps(df.select(key, "ord", "text"), anchors, side, key), f"{side}-rest") for df, side in ((left, "left"), (right, "right")))
    listed = lambda df, name: df.groupBy(key, "gap").agg(F.array_sort(F.collect_list(F.struct("ord", "text", T.tokens(F.col("text")).alias("tokens")))).alias(name))
    both = listed(rest_l, "l").join(listed(rest_r, "r"), [key, "gap"])
    kind = dict(left.dtypes)[key]

    def run(frames):
        for pdf in frames:
            rows = []
            for k, a, b in zip(pdf[key], pdf["l"], pdf["r"], strict=True):
                for x in gap_operations([m["text"] for m in a], [m["text"] for m in b], [list(m["tokens"]) for m in a], [list(m["tokens"]) for m in b]):
                    rows.append((k, x["op"], [a[i]["ord"] for i in x["left"]], [b[j]["ord"] for j in x["right"]], x["cells"]))
            yield pd.DataFrame(rows, columns=[key, "op", "left_ords", "right_ords", "cells"])

    changed = stored(both.mapInPandas(run, f"{key} {kind}, {OPERATIONS}"), "gap-operations")
    used = lambda side: changed.select(key, F.explode(f"{side}_ords").alias("ord"))
    free_l, free_r = rest_l.join(used("left"), [key, "ord"], "left_anti"), rest_r.join(used("right"), [key, "ord"], "left_anti")
    moved = stored(align.greedy_best_first(align.near_moves(free_l, free_r, key), align.MOVE_SCORE, key), "moves")
    same = lambda df: df.select(key, "op", F.array("left_ord").alias("left_ords"), F.array("right_ord").alias("right_ords"), F.lit(None).cast("array<struct<left:string,right:string,mark:string>>").alias("cells"))
    equal = anchors.withColumn("op", F.when(F.col("on_spine"), "Equal").otherwise("Move"))
    if "format" in fields:
        formats = lambda df, side: df.select(key, F.col("ord").alias(f"{side}_ord"), F.col("format").alias(f"{side}_format"))
        equal = equal.join(formats(left, "left"), [key, "left_ord"]).join(formats(right, "right"), [key, "right_ord"])
        equal = equal.withColumn("op", F.when(F.col("on_spine") & ~F.col("left_format").eqNullSafe(F.col("right_format")), "FormatOnly").otherwise(F.col("op")))
    pairs = same(equal).unionByName(changed).unionByName(same(moved.withColumn("op", F.lit("MoveModify"))))
    gone, new = (free.join(moved.select(key, F.col(f"{side}_ord").alias("ord")), [key, "ord"], "left_anti") for free, side in ((free_l, "left"), (free_r, "right")))
    none = F.array().cast("array<bigint>")
    row = lambda df, op, l, r: df.select(key, F.lit(op).alias("op"), l.alias("left_ords"), r.alias("right_ords"), F.lit(None).cast("array<struct<left:string,right:string,mark:string>>").alias("cells"))
    script = pairs.unionByName(row(gone, "Delete", F.array("ord"), none)).unionByName(row(new, "Insert", none, F.array("ord")))
    script = script.withColumns({"lo": F.get("left_ords", F.lit(0)), "ro": F.get("right_ords", F.lit(0))})
    # a deletion stands after the last block before it that both versions have in order
    steady = F.when(F.col("op").isin("Equal", "FormatOnly", "Modify", "Split", "Merge", "CrossParagraphRun"), F.element_at("right_ords", -1))
    behind = F.last(steady, ignorenulls=True).over(W.partitionBy(key).orderBy(F.col("lo").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    script = script.withColumn("at", F.coalesce("ro", F.when(F.col("lo").isNotNull(), behind), F.lit(-1)))
    script = script.withColumn("seq", (F.row_number().over(W.partitionBy(key).orderBy("at", F.col("ro").isNull(), "lo")) - 1).cast("long"))
    if not texts:
        return script.select(key, "seq", "op", "left_ords", "right_ords", "cells")
    # operations, their places and the blocks of both versions meet by document in one shuffle: windows need no other, and
    # neither do both versions, JSON or whatever else is made of a document's script. The left texts of equal blocks are
    # their right ones
    cell = "array<struct<left:string,right:string,mark:string>>"
    place = lambda side: F.transform(f"{side}_ords", lambda ord_, p: F.struct(F.lit(side).alias("side"), p.cast("long").alias("p"), ord_.alias("ord"), F.lit(None).cast("string").alias("op"), F.lit(None).cast(cell).alias("cells")))
    own = F.array(F.struct(F.lit("").alias("side"), F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("ord"), "op", F.col("cells").cast(cell).alias("cells")))
    rows = script.select(key, "seq", F.explode(F.concat(own, place("left"), place("right"))).alias("x")).select(key, "seq", "x.*")
    text = lambda df, side: df.select(key, F.lit(side).alias("side"), "ord", "text")
    rows = rows.unionByName(text(rest_l, "left"), allowMissingColumns=True).unionByName(text(right, "right"), allowMissingColumns=True).repartition(key)
    rows = rows.withColumn("text", F.max("text").over(W.partitionBy(key, "side", "ord"))).where("seq is not null")
    listed = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("p", "ord", "text"))))
    out = rows.groupBy(key, "seq").agg(F.max("op").alias("op"), F.first("cells", ignorenulls=True).alias("cells"), listed("left").alias("l"), listed("right").alias("r"))
    left_texts = F.when(F.col("op").isin("Equal", "FormatOnly", "Move"), F.col("r.text")).otherwise(F.col("l.text"))
    return out.select(key, "seq", "op", F.col("l.ord").alias("left_ords"), F.col("r.ord").alias("right_ords"), left_texts.alias("left_texts"), F.col("r.text").alias("right_texts"), "cells")


def version(script: DataFrame, side: str, key: str = "doc_id") -> DataFrame:
    """key, ord, text of the version that comes from accepting ("right") or rejecting ("left") the whole script. Runs are put
    together from their cells: a mark that the version hasn't joins its cell with the next one."""
    other = "Deleted" if side == "right" else "Inserted"
    told = F.aggregate("cells", F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")), lambda a, c: F.when(
        c["mark"] == other, F.struct(a["done"].alias("done"), F.concat(a["open"], c[side]).alias("open"))).otherwise(
        F.struct(F.array_append(a["done"], F.concat(a["open"], c[side])).alias("done"), F.lit("").alias("open"))), lambda a: a["done"])
    blocks = script.select(key, F.explode(F.arrays_zip(F.col(f"{side}_ords").alias("ord"), F.when(F.col("op") == "CrossParagraphRun", told).otherwise(F.col(f"{side}_texts")).alias("text"))).alias("b"))
    return blocks.select(key, (F.row_number().over(W.partitionBy(key).orderBy("b.ord")) - 1).cast("long").alias("ord"), F.col("b.text").alias("text"))


# Exports --------------------------------------------------------------------------------------------------------------

CELL = "array<struct<left:string,right:string,mark:string>>"
RECORD = f"array<struct<seq:long,op:string,left_ords:array<long>,right_ords:array<long>,left_texts:array<string>,right_texts:array<string>,cells:{CELL}>>"


def script_json(script: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, json of each document's script: its operations in order; fields without a value aren't written."""
    row = F.struct("seq", "op", "left_ords", "right_ords", "left_texts", "right_texts", "cells")
    return script.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


def script_from_json(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """The script of script_json again; a json that isn't one gives no rows."""
    return table.select(key, F.explode(F.from_json("json", RECORD)).alias("x")).select(key, "x.*")


def scoped_script(left: DataFrame, right: DataFrame, key: str = "doc_id", texts: bool = True) -> DataFrame:
    """full_script of each scope of a document by itself (left and right have a column scope: body, headers, footers,
    notes), so a block never moves from one to another; with key and scope instead of one key."""
    unit = F.concat_ws("\x1f", F.col("scope"), F.col(key).cast("string"))
    cut = full_script(left.withColumn("__unit", unit), right.withColumn("__unit", unit), "__unit", texts)
    parts = F.split("__unit", "\x1f")
    return cut.withColumns({"scope": parts[0], key: parts[1].cast(dict(left.dtypes)[key])}).drop("__unit")
