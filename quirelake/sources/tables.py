"""Tables as document models: blocks of texts and pages, sparse cells of any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line of a document: key, ord, text, hash. Null texts have one empty block.

    Documents are dealt to tasks by key first: a file of few row groups would be cut into blocks, and all that follows, by
    as few tasks; windows over a document need no other shuffle then."""
    return docs.repartition(key).select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("ord", "text")).select(
        key, F.col("ord").cast("long").alias("ord"), "text", F.sha2("text", 256).alias("hash"))


def offsets(blocks_: DataFrame, key: str = "doc_id") -> DataFrame:
    """Start and end of each block in the document's joined content (one separator between blocks)."""
    before = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.length("text") + 1).over(before) - 1
    return blocks_.withColumn("end_offset", end.cast("long")).withColumn("start_offset", (end - F.length("text")).cast("long"))


def revised(blocks_: DataFrame, key: str = "doc_id") -> DataFrame:
    """A deterministic revision of every document with four blocks or more: the second block is deleted, the last one
    moved to the front, the third one edited, and a new one appended; shorter documents are unchanged."""
    n = F.count("*").over(W.partitionBy(key))
    b = blocks_.withColumn("n", n)
    long = F.col("n") >= 4
    kept = F.struct(F.when(long & (F.col("ord") == F.col("n") - 1), F.lit(-1)).otherwise(F.col("ord")).cast("long").alias("at"),
                    F.when(long & (F.col("ord") == 2), F.concat("text", F.lit(" edited here"))).otherwise(F.col("text")).alias("text"))
    new = F.struct(F.lit(1_000_000_000).cast("long").alias("at"), F.concat(F.lit("appended block of "), F.col(key).cast("string")).alias("text"))
    # one pass, without a union: the windows over a document share one shuffle
    rows = F.array(F.when(~(long & (F.col("ord") == 1)), kept), F.when(long & (F.col("ord") == 0), new))
    both = b.select(key, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select(key, "x.at", "x.text")
    return both.select(key, (F.row_number().over(W.partitionBy(key).orderBy("at")) - 1).cast("long").alias("ord"), "text", F.sha2("text", 256).alias("hash"))


def sparse_cells(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """A table as a sheet: row, col, ref, kind, value of every cell that isn't null; rows are numbered in the given order.

    The order needs no single task: rows are numbered by their range partition's offset."""
    numbered = row_numbers(df, order)
    cells = F.array(*(F.struct(F.lit(i).cast("long").alias("col"), F.lit(column_letters(i)).alias("letter"), F.lit(dict(df.dtypes)[c].split("(")[0]).alias("kind"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns, 1)))
    out = numbered.select(F.col("row_no").alias("row"), F.explode(cells).alias("c")).where("c.value is not null")
    return out.select("row", "c.col", F.concat("c.letter", F.col("row").cast("string")).alias("ref"), "c.kind", "c.value")


def row_numbers(df: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """df with row_no from 1 in the given order, without a window over everything.

    The first order column cuts the rows into ranges (at approximate quantiles if it is a number or a time, by its first
    two characters if it is a string; nulls first); rows are numbered inside each range, and the ranges' counts, a small
    table, give the offsets."""
    first, kind = F.col(order[0]), dict(df.dtypes)[order[0]]
    if kind == "string":
        cut = df.withColumn("__cut", F.coalesce(F.substring(first, 1, 2), F.lit("")))
    else:
        x = first.cast("double") if kind != "timestamp" else F.unix_micros(first).cast("double")
        found = df.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] or []
        bounds = F.array(*(F.lit(float(v)) for v in sorted(set(found)))) if found else F.array().cast("array<double>")
        cut = df.withColumn("__cut", F.when(first.isNull(), -1).otherwise(F.size(F.filter(bounds, lambda v: v < x))))
    sizes = cut.groupBy("__cut").agg(F.count("*").alias("__n"))
    offsets_ = sizes.withColumn("__from", F.coalesce(F.sum("__n").over(W.orderBy("__cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    numbered = cut.withColumn("row_no", F.row_number().over(W.partitionBy("__cut").orderBy(*order)))
    return numbered.join(offsets_, "__cut").withColumn("row_no", (F.col("row_no") + F.col("__from")).cast("long")).drop("__cut", "__from")


def column_letters(n: int) -> str:
    """1 -> A, 26 -> Z, 27 -> AA."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def html_text(html):
    """Visible text of an HTML column by patterns alone (comments, scripts and styles first, then tags)."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))
