"""Queries that run a stream over the events table to its end and return what it has produced."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.sources.store import shared_dir
from quirelake.sources.tables import load
from quirelake.streaming import sessions


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events file as a stream; a folder is streamed as it is, a single file from its own path by a glob."""
    schema = load(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def drained(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream until its input is used up, writing into a table of the shared folder, and read that back."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def session_stream_state(spark, sf):
    op = F.when(F.col("event_type") == "signup", "undo").when(F.col("event_type") == "error", "redo").otherwise("do")
    log = _stream(spark, sf).select(F.col("user_id").alias("session"), F.col("event_id").alias("event"), op.alias("op"))
    return drained(spark, sessions.undo_redo(log))


def txn_stream_dedup(spark, sf):
    log = _stream(spark, sf).select("user_id", (F.col("event_id") % 97).alias("txn"), F.col("ts").cast("timestamp").alias("ts"))
    out = drained(spark, sessions.once_per_transaction(log, ["user_id", "txn"], "ts", "3650 days"))
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


def arrivals(spark: SparkSession, sf: str, name: str):
    """Events in four spans of time, each fiftieth of the first span arriving with the last one, and after them a row far in
    the future that lets the watermark pass all sessions. A folder, its schema, and a function for each arrival that adds
    its files."""
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    span = (F.unix_micros("ts") - F.unix_micros(F.lit(lo))) * 4 / (F.unix_micros(F.lit(hi)) - F.unix_micros(F.lit(lo)) + 1)
    at = F.floor(span)
    e = e.withColumn("arrival", F.when((at == 0) & (F.col("event_id") % 50 == 0), 3).otherwise(at))
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    last = e.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), "event_type", "value", (F.lit(hi) + F.expr("interval 10 days")).alias("ts"))
    parts = [e.where(F.col("arrival") == k).drop("arrival") for k in range(4)] + [last]
    return folder, last.schema, [lambda df=df: df.write.mode("append").parquet(f"{folder}/in") for df in parts]


def session_window_stream(spark, sf):
    """Sessions of six hours of each user, as a stream that is fed in five arrivals with an hour for late rows."""
    folder, schema, feeds = arrivals(spark, sf, "sessions")
    for feed in feeds:
        feed()
        log = spark.readStream.schema(schema).parquet(f"{folder}/in")
        out = sessions.session_windows(log, "ts", ["user_id"], "6 hours", "1 hour")
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def session_window_late(spark, sf):
    """Rows of each user that came too late for their session."""
    log = load(spark, sf, "events").select("user_id")
    return sessions.late_rows(log, session_window_stream(spark, sf), ["user_id"])


def annotation_overlay_stream(spark, sf):
    """Annotations of each user that events set or remove, kept by an overlay that gets every arrival twice."""
    folder, schema, feeds = arrivals(spark, sf, "overlay")
    change = [F.col("user_id"), (F.col("event_id") % 50).alias("annotation"), F.col("event_id").alias("event"), F.col("value"), (F.col("event_type") == "error").alias("removed")]
    sink = sessions.overlay(f"{folder}/versions", ["user_id", "annotation"], "event")

    def twice(batch, epoch):
        sink(batch, epoch)
        sink(batch, epoch)

    for feed in feeds[:-1]:
        feed()
        log = spark.readStream.schema(schema).parquet(f"{folder}/in").select(*change)
        log.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.parquet(f"{folder}/versions")
    return sessions.overlaid(sessions.folded(versions, ["user_id", "annotation"], "event", 1), ["user_id", "annotation"], "event", "removed")


def windowed_event_counts(spark, sf):
    """Tumbling windows of five minutes; complete mode, as the last windows would wait for later events."""
    e = load(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    w = sessions.windowed_counts(e, "ts", ["event_type"])  # the same plan over a finished table
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (session_stream_state, txn_stream_dedup, windowed_event_counts, session_window_stream, session_window_late, annotation_overlay_stream)}
_SESSIONS = """e AS (
  SELECT event_id, user_id, epoch_us(ts) AS t, event_id % 50 = 0 AND floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * 4 / (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1)) = 0 AS late FROM events
), n AS (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 21600000000 THEN 0 ELSE 1 END AS begins FROM e WHERE NOT late
), s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM n)"""
ORACLES = {
    "session_window_stream": f"WITH {_SESSIONS} SELECT user_id, min(t) AS start, max(t) + 21600000000 AS \"end\", count(*) AS n FROM s GROUP BY user_id, session",
    "session_window_late": f"WITH {_SESSIONS} SELECT user_id, count(*) FILTER (late) AS n_late FROM e GROUP BY user_id",
    "annotation_overlay_stream": "SELECT user_id, event_id % 50 AS annotation, max(event_id) AS event, arg_max(value, event_id) AS value FROM events GROUP BY ALL HAVING arg_max(event_type, event_id) <> 'error'",
    "windowed_event_counts": "SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "txn_stream_dedup": "SELECT user_id, count(DISTINCT event_id % 97) AS n FROM events GROUP BY 1",
}
