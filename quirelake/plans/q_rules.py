"""Queries with rules and detectors that a user gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import rules
from quirelake.sources.tables import load


def _same(state, row):
    """Runs of three events or more of one type."""
    run = state.get("run")
    if run and run[1] == row["event_type"]:
        state["run"] = (*run[:3], run[3] + 1)
        return
    if run and run[3] >= 3:
        yield run
    state["run"] = (row["user_id"], row["event_type"], row["event_id"], 1)


def _last(state):
    if "run" in state and state["run"][3] >= 3:
        yield state["run"]


def rule_event_runs(spark, sf):
    rule = rules.Rule("user_id long, event_type string, first_event long, n long", _same, finish=_last)
    return rule.over(load(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


def detector_findings(spark, sf):
    """Two detectors for two kinds of parts, and one whose kind there is no table of."""
    detectors = {
        "orders": lambda t: t.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'").select(F.col("o_orderkey").alias("part"), F.lit("urgent and open").alias("finding")),
        "customer": lambda t: t.where("c_acctbal < 0").select(F.col("c_custkey").alias("part"), F.lit("in debt").alias("finding")),
        "media": lambda t: t,
    }
    return rules.detected({t: load(spark, sf, t) for t in ("orders", "customer", "nation")}, detectors)


QUERIES = {f.__name__: f for f in (rule_event_runs, detector_findings)}
ORACLES = {
    "rule_event_runs": """WITH g AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events
)
SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM g GROUP BY user_id, event_type, island HAVING count(*) >= 3""",
    "detector_findings": """SELECT 'orders' AS detector, CAST(o_orderkey AS VARCHAR) AS part, 'urgent and open' AS finding FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'in debt' FROM customer WHERE c_acctbal < 0""",
}
