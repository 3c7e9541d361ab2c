"""Structured Streaming twins of the session operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirelake.operators import session

STATE = "undo array<long>, redo array<long>"


def undo_redo(log: DataFrame, depth: int = session.DEPTH) -> DataFrame:
    """session.undo_redo over a stream of (session, event, op): both stacks of each session are kept as state. Events of a
    session must come in order, as from a log partitioned by session; within a batch they are sorted."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        undo, redo = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        pdf = pd.concat(list(parts)).sort_values("event")
        for event, op in zip(pdf["event"].tolist(), pdf["op"], strict=True):
            done = True
            if op == "do":
                undo.append(event)
                redo.clear()
                del undo[: max(0, len(undo) - depth)]
            elif op == "undo" and undo:
                redo.append(undo.pop())
            elif op == "redo" and redo:
                undo.append(redo.pop())
            else:
                done = False
            out.append((key[0], event, len(undo), len(redo), undo[-1] if undo else None, done))
        state.update((undo, redo))
        rows = pd.DataFrame(out, columns=["session", "event", "undo_depth", "redo_depth", "top", "done"])
        yield rows.assign(top=rows["top"].astype("Int64"))

    return log.select("session", "event", "op").groupBy("session").applyInPandasWithState(run, session.REPLAY, STATE, "append", GroupStateTimeout.NoTimeout)


def once_per_transaction(log: DataFrame, txn: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first request of each transaction id; repeats within the watermark are dropped, and ids older than it
    forgotten, so the state is bounded by the rate of requests."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark(txn)


def windowed_counts(log: DataFrame, time: str, by: list[str], size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each kind in tumbling or sliding windows; late ones up to the watermark count."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return log.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def session_windows(log: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Sessions of each key: events less than a gap apart. A session is given out once the watermark has passed its end; a row
    whose own window ends before the watermark is dropped as late, and isn't in any count."""
    w = F.session_window(time, gap)
    return log.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def late_rows(log: DataFrame, sessions: DataFrame, by: list[str]) -> DataFrame:
    """by, n_late: how many rows of each key are in none of its sessions, given all of both."""
    there = sessions.groupBy(*by).agg(F.sum("n").alias("counted"))
    return log.groupBy(*by).agg(F.count("*").alias("n")).join(there, by, "left").select(*by, (F.col("n") - F.coalesce("counted", F.lit(0))).alias("n_late"))


# Overlays -------------------------------------------------------------------------------------------------------------


def overlay(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds one version to an overlay: the last change per key of the batch.

    A batch is written to a folder of its own epoch and overwrites what an attempt before has left there, so a batch that is
    run again after a failure, or is handed over twice, changes nothing. Nothing that is there is read or written anew."""

    def sink(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")
        last.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/epoch={epoch}")

    return sink


def overlaid(versions: DataFrame, keys: list[str], order: str, removed: str) -> DataFrame:
    """What stands after all versions of an overlay, or those up to an epoch that versions has been filtered by: the last
    change of each key unless the column removed says so. An aggregation with a map-side half; ties go to the later epoch."""
    rest = [c for c in versions.columns if c not in (*keys, "epoch")]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "epoch")).alias("x")).select(*keys, "x.*")
    return last.where(~F.coalesce(F.col(removed), F.lit(False))).drop(removed)


def folded(versions: DataFrame, keys: list[str], order: str, epoch: int) -> DataFrame:
    """Versions up to an epoch as one, removals kept, so that old epochs can be replaced by it."""
    rest = [c for c in versions.columns if c not in (*keys, "epoch")]
    old = versions.where(F.col("epoch") <= epoch).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "epoch")).alias("x")).select(*keys, "x.*")
    return old.withColumn("epoch", F.lit(epoch)).unionByName(versions.where(F.col("epoch") > epoch))
