"""Editing sessions as event logs: batches, undo and redo, idempotent transactions, lineage and receipts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Depth of the undo ring.
DEPTH = 50


def batches(steps: DataFrame, batch: list[str], order: str, ok, atomic: bool) -> DataFrame:
    """steps with applied and version: an atomic batch applies all its steps or none; otherwise each step stands alone.
    A batch that applies anything is one version step."""
    w = W.partitionBy(*batch)
    applied = F.bool_and(ok).over(w) if atomic else ok
    return steps.withColumn("applied", F.coalesce(applied, F.lit(False))).withColumn("version_steps", F.max(F.when(F.col("applied"), 1).otherwise(0)).over(w).cast("long"))


def replay(rows: list[tuple], depth: int = DEPTH) -> list[tuple]:
    """(event, op) of one session in order, op: do, undo or redo. For each event: (event, undo depth, redo depth, the
    event now on top or None, whether it did anything)."""
    undo: list = []
    redo: list = []
    out = []
    for event, op in rows:
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
        out.append((event, len(undo), len(redo), undo[-1] if undo else None, done))
    return out


REPLAY = "session long, event long, undo_depth long, redo_depth long, top long, done boolean"


def undo_redo(log: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Replay of (session, event, op); a session's log, which one user has made, is in one task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event")
        rows = replay(list(zip(pdf["event"], pdf["op"], strict=True)), depth)
        out = pd.DataFrame(rows, columns=["event", "undo_depth", "redo_depth", "top", "done"])
        return out.assign(session=key[0], top=out["top"].astype("Int64"))[["session", "event", "undo_depth", "redo_depth", "top", "done"]]

    return log.select("session", "event", "op").groupBy("session").applyInPandas(run, REPLAY)


def first_of_transaction(log: DataFrame, txn: list[str], order: str) -> DataFrame:
    """log with outcome: the first request of a transaction id is applied, later ones with the same body are replayed from
    its answer, with another body they conflict."""
    w = W.partitionBy(*txn).orderBy(order)
    first = F.first("body").over(w.rowsBetween(W.unboundedPreceding, 0))
    return log.withColumn("outcome", F.when(F.row_number().over(w) == 1, "applied").when(first.eqNullSafe(F.col("body")), "replayed").otherwise("conflict"))


def lineage(log: DataFrame, session: str, order: str) -> DataFrame:
    """Check of a log (before, after, seq): a sequence number is used once and without gaps, and a step begins where the
    last one ended. Adds problem: gap, broken or null."""
    w = W.partitionBy(session).orderBy(order)
    last = F.lag("after").over(w)
    return log.withColumn("problem", F.when(F.col("seq") != F.row_number().over(w) - 1, "gap").when(last.isNotNull() & ~last.eqNullSafe(F.col("before")), "broken"))


def chained(log: DataFrame, session: str, order: str, body) -> DataFrame:
    """A receipt digest after every event: sha-256 over all events of the session up to it, in order."""
    w = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("receipt", F.sha2(F.array_join(F.collect_list(F.sha2(body, 256)).over(w), ""), 256))


def budget(log: DataFrame, session: str, order: str, cost: str, most: float) -> DataFrame:
    """The newest events of each session whose costs together stay within the budget (oldest evicted first)."""
    w = W.partitionBy(session).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("held", F.sum(cost).over(w)).withColumn("kept", F.col("held") <= most)
