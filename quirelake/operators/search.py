"""Searching blocks: by text, pattern and kind, with spans, contexts and placeholders."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.functions import text as T

# The patterns of unfinished workflow text, by kind.
RESIDUE = (
    ("double_brace", "\\{\\{[^{}\\r\\n]{1,256}\\}\\}"),
    ("dollar_brace", "\\$\\{[^{}\\r\\n]{1,256}\\}"),
    ("angle_placeholder", "<<[^<>\\r\\n]{1,256}>>"),
    ("explicit_bracket_placeholder", "\\[(?:_{3,}|\\.{3,}|(?:INSERT|ENTER|TYPE)\\b[^\\]\\r\\n]{0,192})\\]"),
    ("underscore", "_{3,}"),
)
#: A clause in brackets, of which one alternative is to be chosen.
ALTERNATIVE = "\\[[^\\]\\r\\n]{1,256}\\]"
PLACEHOLDER = "\\$?\\[[^\\[\\]]*\\]"


def find_text(blocks: DataFrame, needle: str, ignore_case: bool = True, ignore_space: bool = True) -> DataFrame:
    """Blocks that contain needle; no-break spaces count as spaces and runs of spaces as one if space is ignored."""
    def norm(c):
        c = F.lower(c) if ignore_case else c
        return F.regexp_replace(F.translate(c, " ", " "), "[ \\t]+", " ") if ignore_space else c

    return blocks.where(F.contains(norm(F.col("text")), norm(F.lit(needle))))


def first_per(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first found block of each document."""
    return found.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("ord"))).where("__n = 1").drop("__n")


def grep_first(blocks: DataFrame, pattern: str, mode: str = "char", width: int = 80) -> DataFrame:
    """The first match of a pattern in each block, with its start and context. Built-in functions only."""
    out = blocks.where(F.col("text").rlike(pattern)).withColumn("match", F.regexp_extract("text", pattern, 0))
    # what stands before the first place where the pattern fits; a look-ahead adds no group, so back-references hold
    out = out.withColumn("start", F.length(F.regexp_extract("text", f"^(?s:.*?)(?={pattern})", 0)))
    end = F.col("start") + F.length("match")
    return out.withColumn("before", T.before_context(F.col("text"), F.col("start"), mode, width)).withColumn("after", T.after_context(F.col("text"), end, mode, width))


def grep(blocks: DataFrame, pattern: str, width: int = 80) -> DataFrame:
    """All matches with spans, groups and contexts; the columns of blocks are kept. Python's regular expressions."""
    def run(it):
        rx = re.compile(pattern)
        for pdf in it:
            found = [[(m.start(), m.end(), m.group(), list(m.groups()), t[max(0, m.start() - width) : m.start()], t[m.end() : m.end() + width]) for m in rx.finditer(t)] for t in pdf["text"].fillna("")]
            flat = [x for f in found for x in f]
            out = pdf.loc[np.repeat(pdf.index, [len(f) for f in found])].reset_index(drop=True)
            for i, name in enumerate(("start", "end", "match", "groups", "before", "after")):
                out[name] = pd.Series([x[i] for x in flat], dtype=object if i > 1 else "int64")
            yield out

    schema = ", ".join(f"`{n}` {t}" for n, t in blocks.dtypes) + ", start long, end long, match string, groups array<string>, before string, after string"
    return blocks.mapInPandas(run, schema)


def spans_of(text, pattern: str):
    """start and end of all matches in a text, in its own row. Python's regular expressions."""

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def found(texts: pd.Series) -> pd.Series:
        rx = re.compile(pattern)
        return pd.Series([[{"start": m.start(), "end": m.end()} for m in rx.finditer(t)] for t in texts.fillna("")])

    return found(text)


def grep_across(parts: DataFrame, group: list[str], order: str, pattern: str) -> DataFrame:
    """Matches in the joined text of each group of adjacent parts (joined by a line end), with the slice of every part
    that a match touches: group, match_no, match, part order, slice_start, slice_end."""
    w = W.partitionBy(*group).orderBy(order)
    placed = parts.withColumn("from", F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = parts.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("text"))
    hits = grep(joined, pattern).select(*group, (F.row_number().over(W.partitionBy(*group).orderBy("start")) - 1).alias("match_no"), "match", "start", "end")
    both = hits.join(placed, group).where((F.col("start") < F.col("from") + F.length("text")) & (F.col("end") > F.col("from")))
    return both.select(*group, "match_no", "match", order, F.greatest(F.col("start") - F.col("from"), F.lit(0)).alias("slice_start"), F.least(F.col("end") - F.col("from"), F.length("text")).alias("slice_end"))


def placeholders(blocks: DataFrame) -> DataFrame:
    """Innermost bracketed placeholders: nth, placeholder, kind (blank, instruction, alternative) and hint."""
    out = blocks.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0))).alias("nth", "placeholder"))
    inner = F.regexp_replace("placeholder", "^\\$?\\[|\\]$", "")
    kind = F.when(inner.rlike("^[_ ]*$"), "blank").when(inner.rlike("(?i)^\\*|insert|specify|note"), "instruction").when(inner.rlike("/| or "), "alternative").otherwise("fill")
    return out.withColumn("kind", kind).withColumn("hint", F.trim(F.regexp_replace(inner, "[*_]+", "")))


def residue(blocks: DataFrame) -> DataFrame:
    """Matches of every residue pattern: code (its kind) and match."""
    found = F.array(*(F.struct(F.lit(code).alias("code"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("m")) for code, p in RESIDUE))
    out = blocks.select("*", F.explode(found).alias("f")).select("*", "f.code", F.explode("f.m").alias("match"))
    return out.drop("f")


def replace_text(text, needle: str, to: str, match_case: bool):
    """Literal search and replace."""
    return F.replace(text, F.lit(needle), F.lit(to)) if match_case else F.regexp_replace(text, "(?i)" + re.escape(needle), to.replace("\\", "\\\\").replace("$", "\\$"))


def fill(text, values: dict[str, str], passes: int = 8):
    """Fill innermost placeholders by their inner text, again and again, as filling may complete outer ones. Placeholders
    without a value stay. $[x] keeps its sign."""
    for _ in range(passes):
        for inner, value in values.items():
            text = F.replace(text, F.lit(f"[{inner}]"), F.lit(value))
    return text


def occurrences(docs: DataFrame, needles: DataFrame, limit: int = 100) -> DataFrame:
    """doc_id, item_id, nth, start: where each needle's text occurs, overlaps too. Documents and needles meet by the
    needle's first word (a needle of whole words), then starts are checked exactly."""
    n = needles.select("item_id", F.col("text").alias("needle"), F.split("text", " ")[0].alias("w"))
    d = docs.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", "[ \\n]"))).alias("w")).join(n, "w").where(F.contains("text", "needle"))
    hits = d.select("doc_id", "item_id", F.posexplode(T.occurrences(F.col("text"), F.col("needle"), limit)).alias("nth", "start"))
    return hits.select("doc_id", "item_id", F.col("nth").cast("long").alias("nth"), F.col("start").cast("long").alias("start"))
