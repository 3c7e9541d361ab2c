"""Line dedup by distinct-site spread: HyperLogLog sketches per line hash, exact counts near the threshold.

DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import common

#: A line found on at least this many distinct sites is boilerplate.
MIN_SITES = 15
#: log2 of a sketch's registers; its relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 8
#: Estimates within this many standard errors of the threshold are counted exactly.
NEAR = 4.0


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, site, line_no, line_hash of every line with a word. Lines are compared by a 64-bit hash of their text
    without white space at either end; text_key tells rows apart that repeat a doc_id with another text."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("source", F.lit("")).alias("site"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    bare = F.regexp_replace("line", "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    cut = cut.select("doc_id", "text_key", "site", "line_no", bare.alias("line")).where("line <> ''")
    return cut.select("doc_id", "text_key", "site", "line_no", F.xxhash64("line").alias("line_hash"))


def spread(cut: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """line_hash of the lines on at least min_sites distinct sites, and their first document.

    Each task sketches the sites of each line hash it meets and the sketches are merged by the aggregation, so a line
    found everywhere costs one row per task. The estimate decides where it is near standard errors or more from the
    threshold; the others, few, are counted exactly. A line on fewer rows than min_sites is dropped by its count."""
    error = near * 1.04 / math.sqrt(2**lg_k)
    sketched = cut.groupBy("line_hash").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    sketched = sketched.where(F.col("n") >= min_sites).select("line_hash", "first_doc", F.hll_sketch_estimate("sketch").alias("sites"))
    sketched = common.materialize(sketched.where(F.col("sites") >= min_sites * (1 - error)), "line-sites")
    sure = sketched.where(F.col("sites") > min_sites * (1 + error)).select("line_hash", "first_doc")
    close = sketched.where(F.col("sites") <= min_sites * (1 + error)).select("line_hash", "first_doc")
    exact = cut.select("line_hash", "site").join(common.small_or_not(close.select("line_hash"), 16), "line_hash", "left_semi")
    exact = exact.distinct().groupBy("line_hash").count().where(F.col("count") >= min_sites)
    return sure.unionByName(close.join(exact.select("line_hash"), "line_hash"))


def stripped(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs, each row as often as before, with text without cross-site boilerplate lines, and __gone: the numbers of the
    lines that went, null if none did; see line_dedup()."""
    cut = lines(docs)
    bad = common.materialize(spread(cut, min_sites), "line-boilerplate")
    bad = common.small_or_not(bad, 32)
    hits = cut.join(bad, "line_hash").select("doc_id", "text_key", "line_no", "line_hash", "first_doc")
    # one row per document and line hash: where it occurs, and whether its first occurrence stays
    hits = hits.groupBy("doc_id", "text_key", "line_hash").agg(F.min("line_no").alias("first_no"), F.first("first_doc").alias("first_doc"), F.collect_set("line_no").alias("nos"))
    gone = F.when(F.col("doc_id") == F.col("first_doc"), F.array_remove("nos", F.col("first_no"))).otherwise(F.col("nos"))
    gone = hits.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.flatten(F.collect_list(gone)).alias("__gone"))
    gone = gone.where(F.size("__gone") > 0)
    out = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key")), "left").drop("__id", "__key")
    # the numbers that stay come from a set difference, so a text of very many lines takes time in proportion
    out = out.withColumn("__parts", F.when(F.col("__gone").isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), "__gone")
    left = F.array_join(F.transform(stay, lambda i: F.get("__parts", i)), "\n")
    return out.withColumn("text", F.when(F.col("__gone").isNotNull(), left).otherwise(F.col("text"))).drop("__parts")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs, each row as often as before, with text without cross-site boilerplate lines and three more columns:
    n_lines (with a word), n_removed, n_words_before.

    A boilerplate line stays in the document with the smallest doc_id that has it (once, at its first place), so nothing
    vanishes from the corpus; its other occurrences go. A null source is a site of its own; blank lines are never
    removed; a null text stays null; rows that repeat a doc_id are treated alike if their texts are equal, else each by its
    own; a null doc_id loses all its boilerplate lines. Columns of docs are kept (those with the three names are
    replaced); texts may be of any length; an empty table gives no rows."""
    word_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), ""))
    counted = docs.withColumns({"n_lines": word_lines.cast("long"), "n_words_before": words.cast("long")})
    out = stripped(counted, min_sites)
    return out.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).drop("__gone")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(common.table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {
    "op2_line_dedup": r"""
WITH cut AS (
  SELECT doc_id, coalesce(source, '') AS site, i AS line_no, p[i] AS raw, regexp_replace(p[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), LATERAL unnest(range(1, len(p) + 1)) AS u(i)
), bad AS (
  SELECT line, min(doc_id) AS first_doc FROM cut WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 15
), marked AS (
  SELECT cut.*, bad.line IS NOT NULL AND NOT (cut.doc_id = bad.first_doc AND cut.line_no = min(cut.line_no) OVER (PARTITION BY cut.doc_id, cut.line)) AS gone
  FROM cut LEFT JOIN bad ON cut.line = bad.line
), docs AS (
  SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS left_text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, CAST(length(left_text) AS BIGINT) AS n_chars_left, sha256(left_text) AS text_sha256 FROM docs
""",
}
