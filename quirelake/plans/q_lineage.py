"""Queries on the lineage of deliveries: each user's events as a history of transactions, undo and redo."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.operators import lineage
from quirelake.plans.q_streams import drained
from quirelake.sources.store import shared_dir
from quirelake.sources.tables import load


def _history(spark, sf):
    """Cycles of six steps: two commits, the second one undone and redone, a failure and a prediction. In histories of twelve
    steps or more, all but each tenth user's have one breach of a rule of its own."""
    e = load(spark, sf, "events").select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("p"))
    e = e.withColumn("n", F.count("*").over(W.partitionBy("user_id")))
    q, r, kind = F.floor(F.col("p") / 6), F.col("p") % 6, F.when(F.col("n") >= 12, F.col("user_id") % 10).otherwise(0)
    breach = lambda k, at: (kind == k) & (F.col("p") == at)
    entry = lambda x: F.concat(F.lit("e"), x.cast("string"))
    before = F.when((q == 0) & (r == 0), "source").when(r == 0, entry(6 * q - 5)).when((r == 1) | (r == 3), entry(6 * q)).otherwise(entry(6 * q + 1))
    after = F.when((r == 0) | (r == 2), entry(6 * q)).otherwise(entry(6 * q + 1))
    version = 4 * q + F.least(r, F.lit(4))
    action = F.element_at(F.array(*[F.lit(x) for x in ("committed", "committed", "undo", "redo", "failed", "prediction")]), (r + 1).cast("int"))
    affected = F.when((r == 2) | (r == 3), entry(6 * q + 1 - (breach(6, 8) | breach(7, 9)).cast("long"))).otherwise(entry(F.col("p")))
    log = e.select(
        "user_id", F.when(breach(1, 6), 100).otherwise(F.col("p")).cast("long").alias("seq"), action.alias("action"), affected.alias("entry"), (version + breach(2, 6).cast("long")).alias("before_version"), before.alias("before_digest"),
        (version + (r < 4).cast("long") + (breach(3, 6) | breach(5, 11)).cast("long")).alias("after_version"), F.when(breach(4, 10) | breach(8, 8), "other").otherwise(after).alias("after_digest"), (r < 4).alias("succeeded"))
    last = e.where("p = n - 1").select("user_id", F.lit(0).cast("long").alias("source_version"), F.lit("source").alias("source_digest"), (version + (r < 4).cast("long")).alias("delivered_version"), F.when(kind == 9, "other").otherwise(after).alias("delivered_digest"))
    return log, last


def lineage_findings(spark, sf):
    return lineage.findings(*_history(spark, sf), "user_id")


def lineage_stream_findings(spark, sf):
    """The same histories as a stream; what is delivered isn't known to it."""
    log, _ = _history(spark, sf)
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    log.write.parquet(path)
    return drained(spark, lineage.watched(spark.readStream.schema(log.schema).parquet(path), "user_id")).select("user_id", "finding")


QUERIES = {f.__name__: f for f in (lineage_findings, lineage_stream_findings)}

_FOUND = "CASE WHEN count(*) >= 12 THEN CASE user_id % 10 WHEN 1 THEN 'sequence' WHEN 2 THEN 'transactionGap' WHEN 3 THEN 'transactionVersion' WHEN 4 THEN 'failedChanged' WHEN 5 THEN 'prediction' WHEN 6 THEN 'undoOrder' WHEN 7 THEN 'redoOrder' WHEN 8 THEN 'content' WHEN 9 THEN 'delivered' END END"
ORACLES = {
    "lineage_findings": f"SELECT user_id, {_FOUND} IS NULL AS valid, {_FOUND} AS finding FROM events GROUP BY user_id",
    "lineage_stream_findings": f"SELECT * FROM (SELECT user_id, {_FOUND} AS finding FROM events GROUP BY user_id) WHERE finding IS NOT NULL AND finding <> 'delivered'",
}
