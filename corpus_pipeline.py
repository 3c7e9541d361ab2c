"""From raw documents to packed training sequences, one operator of quirelake.llm for each stage.

Each stage works on all documents that the one before has kept and is written as Parquet in the shared folder, so a lost
executor repeats at most the tasks of one stage. Each row goes by its own text; a doc_id may be null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import common, decontaminate, lines, packing, partenum, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and whose perplexity lies in their language's band.

    The verdict depends on language and text alone, so each row has its own, whatever its doc_id: null, repeated or not.
    Null and empty texts fail the fixed rules. An empty table stays empty; all columns are passed through."""
    common.tune(spark)
    verdict = quality.quality_rules(docs).where("not kept").select(F.col("lang").alias("__lang"), F.col("text_key").alias("__key"))
    rejected = common.materialize(verdict.distinct(), "rejected")
    same = docs["lang"].eqNullSafe(F.col("__lang")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(common.small_or_not(rejected, 32), same, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; those go that have no word left without them.

    A text that loses nothing stays, also a null or empty one; rows that repeat a doc_id go by their own texts. All columns
    are passed through; n_chars, if there and a number, is that of the new text. An empty table stays empty."""
    out = lines.stripped(docs)
    out = out.where(F.col("__gone").isNull() | (count_words(F.col("text")) > 0))
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def count_words(text):
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), packing.SPACE), "")).cast("long")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (5-word shingles, similarity 0.8 or more).

    Each row is judged by its own text: rows that repeat a doc_id stay if their texts are no near copies of each other. A
    text without words is no copy of anything and stays, and so does a text that only rows without a doc_id have. All
    columns are passed through; an empty table stays empty."""
    common.tune(spark)
    rows = common.materialize(partenum.linked_rows(docs, words=5, num=80, den=100), "near-groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    copies = rows.where(~first).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    firsts = rows.where(first & F.col("doc_id").isNotNull()).select("doc_id", "text_key", F.coalesce("root", "text_key").alias("root"))
    again = common.materialize(firsts.groupBy("doc_id", "root").agg(F.min("text_key").alias("stays"), F.count("*").alias("n")).where("n > 1"), "repeated-ids", narrow=True)
    repeated = again.limit(1).count() > 0
    if repeated:
        copies = copies.unionByName(firsts.join(common.small_or_not(again, 32), ["doc_id", "root"]).where("text_key <> stays").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")))
    copies = common.materialize(copies.distinct(), "near-copies")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    out = docs.join(common.small_or_not(copies, 32), same, "left_anti")
    if not repeated:
        return out
    again = common.small_or_not(again.select(F.col("doc_id").alias("__id"), F.col("stays").alias("__key")).distinct(), 32)
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item (the whole item if it is shorter).

    Each row is judged by its text, whatever its doc_id; null and empty texts stay; repeated rows go or stay together. All
    columns are passed through; an empty table, or an empty benchmark, changes nothing."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, one row for each: its text, and the doc_ids and places of the pieces in it.

    Null, empty and blank texts give no piece; a null doc_id is null in the list; repeated rows are packed as often as they
    occur; an empty table gives no rows."""
    common.tune(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the Kneser-Ney bands nor best-fit packing; tests/llm hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return common.materialize(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
