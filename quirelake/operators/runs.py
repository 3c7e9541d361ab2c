"""Matches over runs: where a match in a block's text lies in its runs, and replacements that leave other runs alone."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def run_offsets(runs: DataFrame, by: list[str]) -> DataFrame:
    """runs (by, run, text) with lo and hi: the characters of the block's text that each has. Null texts have none."""
    hi = F.sum(F.length(F.coalesce("text", F.lit("")))).over(W.partitionBy(*by).orderBy("run").rowsBetween(W.unboundedPreceding, 0))
    return runs.withColumn("hi", hi.cast("long")).withColumn("lo", F.col("hi") - F.length(F.coalesce("text", F.lit(""))))


def block_text(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, text: the runs' texts in order."""
    listed = F.array_sort(F.collect_list(F.struct("run", F.coalesce("text", F.lit("")).alias("text"))))
    return runs.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("text"))


def spans(texts: list[str | None], starts: list[int], ends: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(match, run, from, to) of each part of a run that a match has; matches are in order and don't overlap."""
    hi = np.cumsum([len(t or "") for t in texts]).tolist()
    for k, (start, end) in enumerate(zip(starts, ends, strict=True)):
        i = bisect.bisect_right(hi, start)
        while i < len(texts) and (lo := hi[i] - len(texts[i] or "")) < end:
            if hi[i] > lo:
                yield k, i, max(start, lo) - lo, min(end, hi[i]) - lo
            i += 1


def _listed(runs: DataFrame, matches: DataFrame, by: list[str], more: list[str], how: str) -> DataFrame:
    """by, r (all runs of a block in order), m (its matches in order: start, end and more). A block's runs stand in one task
    as a rule, so what is shuffled is a row for each block; what follows stays dealt by block."""
    rest = [c for c in runs.columns if c not in by and c != "run"]
    r = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("run", *rest))).alias("r"))
    m = matches.where("end > start").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *more))).alias("m"))
    return r.join(m, by, how)


def fragments(runs: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """by, start, end, run, from, to, text: the part of each run that each match has, as characters of the run. matches (by,
    start, end) don't overlap."""
    return fragments_listed(_listed(runs, matches, by, [], "inner"), by)


def fragments_listed(x: DataFrame, by: list[str]) -> DataFrame:
    """fragments of blocks that have all their runs and matches in one row already (by, r, m): nothing is shuffled or sorted."""

    @F.pandas_udf("array<struct<match:int,place:int,from:long,to:long,text:string>>")
    def found(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([[{"match": k, "place": i, "from": a, "to": b, "text": t[i][a:b]} for k, i, a, b in spans(list(t), s, e)] for t, s, e in zip(texts, starts, ends, strict=True)])

    x = x.where(F.size("m") > 0).select(*by, F.col("r.run").alias("runs"), F.col("m.start").alias("starts"), F.col("m.end").alias("ends"), F.explode(found("r.text", "m.start", "m.end")).alias("f"))
    return x.select(*by, F.get("starts", F.col("f.match")).alias("start"), F.get("ends", F.col("f.match")).alias("end"), F.get("runs", F.col("f.place")).alias("run"), "f.from", "f.to", "f.text")


def replaced(runs: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """runs with the replacement (a column of matches) of each match in the run in which it begins, and without its text in
    all others. Runs keep their number, format and other columns; those that lose all their text stay empty, and blocks
    without a match are as before."""

    x = replaced_listed(_listed(runs, matches, by, ["replacement"], "left")).select(*by, F.explode(F.arrays_zip("r", "t")).alias("x"))
    return x.select(*[F.col("x.t").alias(c) if c == "text" else c if c in by else F.col(f"x.r.{c}").alias(c) for c in runs.columns])


def replaced_listed(x: DataFrame) -> DataFrame:
    """replaced of blocks that have all their runs and matches in one row already (r, m): with t, the runs' new texts."""

    @F.pandas_udf("array<string>")
    def put(texts: pd.Series, starts: pd.Series, ends: pd.Series, news: pd.Series) -> pd.Series:
        out = []
        for t, s, e, new in zip(texts, starts, ends, news, strict=True):
            if t is None:
                out.append(None)
                continue
            t = list(t)
            hits = list(spans(t, s, e))
            first = {}
            for k, i, _, _ in hits:
                first.setdefault(k, i)
            for k, i, a, b in reversed(hits):
                t[i] = t[i][:a] + ((new[k] or "") if first[k] == i else "") + t[i][b:]
            out.append(t)
        return pd.Series(out)

    some = lambda c: F.when(F.size("m") > 0, F.col(c))
    return x.withColumn("t", F.coalesce(put(some("r.text"), some("m.start"), some("m.end"), some("m.replacement")), F.col("r.text")))
