"""Layout estimates, affixes, splits and merges, table differences, localized ordinals."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.operators import align, structure

#: Bounds of split detection: blocks in a run, share of the block's words that the run covers, foreign words in the run.
RUN, COVERAGE, FOREIGN = 8, 0.90, 0.34


def text_width(text, size: float = 11.0):
    """Estimated width in points: narrow, wide and other characters by class."""
    n = F.length(text)
    narrow, wide = F.regexp_count(text, F.lit("[ijlt.,:;!'| ]")), F.regexp_count(text, F.lit("[mwMW@%]"))
    return (narrow * 0.28 + wide * 0.85 + (n - narrow - wide) * 0.55) * size


def trimmed(a, b):
    """What differs between two texts once common words at both ends are dropped: (left, right)."""
    x, y = F.split(a, " "), F.split(b, " ")

    def shared(u, v):
        """How many words two lists begin with alike."""
        same = F.zip_with(u, v, lambda p, q: p.eqNullSafe(q))
        return (F.when(F.array_contains(same, False), F.array_position(same, F.lit(False)) - 1).otherwise(F.size(same))).cast("int")

    head = shared(x, y)
    left, right = F.slice(x, head + 1, F.size(x)), F.slice(y, head + 1, F.size(y))
    tail = F.when((F.size(left) > 0) & (F.size(right) > 0), F.least(shared(F.reverse(left), F.reverse(right)), F.size(left), F.size(right))).otherwise(0)
    cut = lambda w: F.array_join(F.slice(w, F.lit(1), F.size(w) - tail), " ")
    return F.struct(cut(left).alias("left"), cut(right).alias("right"))


def page_flow(blocks: DataFrame, key: str, height: int = 54, per_line: int = 78) -> DataFrame:
    """key, ord, page: lines of each block flow down the page; a block that doesn't fit begins the next page, and one
    that is taller than a page runs over as many as it needs. A heading (a short block) stays with the block after it."""
    lines = F.greatest(F.lit(1), F.ceil(F.length("text") / per_line)).cast("int")
    b = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", lines.alias("n"), (F.length("text") < 40).alias("head")))).alias("b"))
    b = b.withColumn("b", F.transform("b", lambda x, i: F.struct(x["ord"].alias("ord"), x["n"].alias("n"), (x["n"] + F.when(x["head"], F.coalesce(F.get("b", i + 1)["n"], F.lit(0))).otherwise(0)).alias("need"))))
    zero = F.struct(F.lit(1).alias("page"), F.lit(0).alias("used"), F.array().cast("array<struct<ord:bigint,page:int>>").alias("out"))

    def step(s, x):
        fresh = (s["used"] > 0) & (s["used"] + F.least(x["need"], F.lit(height)) > height)
        page, used = F.when(fresh, s["page"] + 1).otherwise(s["page"]), F.when(fresh, 0).otherwise(s["used"]) + x["n"]
        return F.struct((page + F.floor((used - 1) / height).cast("int")).alias("page"), ((used - 1) % height + 1).alias("used"), F.concat(s["out"], F.array(F.struct(x["ord"].alias("ord"), page.alias("page")))).alias("out"))

    return b.select(key, F.explode(F.aggregate("b", zero, step)["out"]).alias("o")).select(key, "o.ord", F.col("o.page").cast("long").alias("page"))


def split_run(whole: list[str], parts: list[Counter], starts: list[int], most: int = RUN) -> tuple[int, int] | None:
    """The first run of two to most adjacent parts that holds the words of a block: from, to; None if there is none.
    starts: parts in order that share words with the block, the only ones that a run can begin with."""
    want = Counter(whole)
    for a in starts:
        got: Counter = Counter()
        for b in range(a, min(len(parts), a + most)):
            got += parts[b]
            both = sum((got & want).values())
            if sum(got.values()) - both > FOREIGN * max(sum(got.values()), len(whole)):
                break
            if b > a and whole and both >= COVERAGE * len(whole) and sum(got.values()) - both <= FOREIGN * sum(got.values()):
                return a, b
    return None


def splits(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, first, last: leftover left blocks that were split into a run of adjacent leftover right ones. Swap the
    sides to find merges."""

    def run(frames):
        for pdf in frames:
            out = []
            for k, lo, lw, ro, rw in zip(pdf[key], pdf["left_ords"], pdf["left_words"], pdf["right_ords"], pdf["right_words"], strict=True):
                parts = [Counter(w) for w in rw]
                for i, at, shared, _, sizes in align.common_words(list(lw), list(rw), False, 0.0):
                    found = split_run(list(lw[i]), parts, at[shared >= (1 - FOREIGN) * sizes].tolist())
                    if found:
                        out.append((k, lo[i], ro[found[0]], ro[found[1]]))
            yield pd.DataFrame(out, columns=[key, "ord", "first", "last"])

    # blocks without words are parts that a run may go over
    both = align.listed_words(left, [key], "left", 0).join(align.listed_words(right, [key], "right", 0), key)
    return both.mapInPandas(run, f"{key} {dict(left.dtypes)[key]}, ord long, first long, last long")


def table_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Row operations between two versions of tables (keys, row, cells: an array): rows with a unique equal hash are Equal
    (Moved if they cross). Leftovers between two of the equal rows are aligned as structure.monotone_rows does it: Modified
    with the columns that differ (Equal if none does), the rest is Deleted or Inserted. One gap of a table is in memory at a
    time."""
    # both versions' rows are one table, so that a table is shuffled once and its windows need nothing else
    side = lambda df, name: df.select(*keys, "row", "cells", F.unhex(F.sha2(F.to_json("cells"), 256)).alias("hash"), F.lit(name).alias("side"))
    met = W.partitionBy(*keys, "hash")
    on = lambda name: F.when(F.col("side") == name, F.col("row"))
    once = (F.count(F.when(F.col("side") == "old", 1)).over(met) == 1) & (F.count(F.when(F.col("side") == "new", 1)).over(met) == 1) & F.col("hash").isNotNull()
    both = side(old, "old").unionByName(side(new, "new")).repartition(*keys).withColumns({"paired": once, "o": F.max(on("old")).over(met), "n": F.max(on("new")).over(met)})
    both = both.select(*keys, "row", "side", "paired", *(F.when(F.col("paired"), F.col(c)).alias(c) for c in ("o", "n")), F.when(~F.col("paired"), F.col("cells")).alias("cells"))
    before = W.partitionBy(*keys, "side").orderBy("o").rowsBetween(W.unboundedPreceding, -1)
    both = both.withColumn("op", F.when(F.col("paired"), F.when(F.max("n").over(before) > F.col("n"), "Moved").otherwise("Equal")))
    both = both.withColumn("gap", F.count(F.when(F.col("op") == "Equal", 1)).over(W.partitionBy(*keys, "side").orderBy("row").rowsBetween(W.unboundedPreceding, 0)))
    # pairs are handed through beside the gaps, so that all before is done once
    listed = lambda name: F.array_sort(F.collect_list(F.when(~F.col("paired") & (F.col("side") == name), F.struct("row", "cells"))))
    pairs = F.collect_list(F.when(F.col("paired") & (F.col("side") == "old"), F.struct("o", "n", "op")))
    gaps = both.groupBy(*keys, "gap").agg(listed("old").alias("old_row"), listed("new").alias("new_row"), pairs.alias("pairs"))

    def run(frames):
        for pdf in frames:
            out = []
            for k, a, b, same in zip(pdf[keys].itertuples(index=False, name=None), pdf["old_row"], pdf["new_row"], pdf["pairs"], strict=True):
                out += [(*k, x["o"], x["n"], x["op"], None) for x in same]
                pairs = structure.monotone_rows([list(x["cells"]) for x in a], [list(x["cells"]) for x in b])
                used = {i for i, _ in pairs}, {j for _, j in pairs}
                for i, j in pairs:
                    x, y = list(a[i]["cells"]), list(b[j]["cells"])
                    differ = [str(c) for c in range(max(len(x), len(y))) if x[c : c + 1] != y[c : c + 1]]
                    out.append((*k, a[i]["row"], b[j]["row"], "Modified" if differ else "Equal", ",".join(differ) or None))
                out += [(*k, x["row"], None, "Deleted", None) for i, x in enumerate(a) if i not in used[0]] + [(*k, None, x["row"], "Inserted", None) for j, x in enumerate(b) if j not in used[1]]
            yield pd.DataFrame(out, columns=[*keys, "old_row", "new_row", "op", "columns"]).astype({"old_row": "Int64", "new_row": "Int64"})

    kinds = dict(old.dtypes)
    return gaps.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", old_row long, new_row long, op string, columns string")


def ordinal_in(n, language: str):
    """An ordinal number as it is written in a language."""
    s = n.cast("string")
    return {
        "fr": lambda: F.when(n == 1, "1er").otherwise(F.concat(s, F.lit("e"))),
        "de": lambda: F.concat(s, F.lit(".")),
        "es": lambda: F.concat(s, F.lit("º")),
        "sv": lambda: F.concat(s, F.when((n % 10).isin(1, 2) & ~(n % 100).isin(11, 12), ":a").otherwise(":e")),
        "tr": lambda: F.concat(s, F.lit(".")),
        "ru": lambda: F.concat(s, F.lit("-й")),
        "zh": lambda: F.concat(F.lit("第"), s),
    }[language]()
