"""Queries on deltas, verification, merging and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import delta, session
from quirelake.sources.tables import blocks, load, revised


def _orders(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def _changed_orders(spark, sf):
    """Every 7th order is gone, every 5th changed, and each 11th has a new one beside it."""
    o = _orders(spark, sf)
    kept = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return kept.unionByName(o.where("o_orderkey % 11 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


CHANGED = """changed AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 = 0)"""
VALUES = ["o_custkey", "o_orderstatus", "o_orderpriority"]


def package_delta(spark, sf):
    return delta.delta(_orders(spark, sf), _changed_orders(spark, sf), ["o_orderkey"], VALUES).select("o_orderkey", "change")


def semantic_changes_ordered(spark, sf):
    c = delta.field_changes(_orders(spark, sf), _changed_orders(spark, sf), ["o_orderkey"], VALUES)
    return delta.canonical_order(c, ["field", "before", "after"], ["o_orderkey"])


def _lines(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")


def duplicate_key_delta(spark, sf):
    """Lines are keyed by order and flag, so keys repeat; the second version drops the first line of every 3rd order."""
    keys = ["l_orderkey", "l_returnflag"]
    old = delta.numbered(_lines(spark, sf), keys, ["l_linestatus"])
    new = delta.numbered(_lines(spark, sf), ["l_orderkey"], ["l_returnflag", "l_linestatus"], "line").where("not (l_orderkey % 3 = 0 and line = 0)").drop("line")
    new = delta.numbered(new, keys, ["l_linestatus"])
    return delta.delta(old, new, [*keys, "occurrence"], ["l_linestatus"]).groupBy("change").agg(F.count("*").alias("n"))


def expectation_bag_diff(spark, sf):
    want, got = _lines(spark, sf).where("l_orderkey % 10 <> 1"), _lines(spark, sf).where("l_orderkey % 10 <> 2")
    return delta.bag_difference(want, got).groupBy("side", "l_returnflag").agg(F.count("*").alias("n"))


def expectation_wildcards(spark, sf):
    """Orders against rules with wildcards; the most specific rule wins and is used once."""
    rules = spark.createDataFrame([(1, None, None), (2, "F", None), (3, None, "1-URGENT"), (4, "F", "1-URGENT"), (5, "O", "5-LOW")], "rule long, o_orderstatus string, o_orderpriority string")
    a = _orders(spark, sf).select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    return delta.expect(a, rules, ["o_orderstatus", "o_orderpriority"]).where("rule is not null")


def finding_disposition(spark, sf):
    """Repeated blocks as findings, before and after a revision."""
    left = blocks(load(spark, sf, "documents"))
    return delta.classify(revised(left), left, ["doc_id", "hash"], ["ord"]).groupBy("doc_id", "disposition").agg(F.count("*").alias("n"))


def verify_decision(spark, sf):
    left = blocks(load(spark, sf, "documents"))
    c = delta.classify(revised(left), left, ["doc_id", "hash"], ["ord"])
    return delta.decide(c, ["doc_id"], F.lit(True))


def closure_orphans(spark, sf):
    o = _changed_orders(spark, sf)
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    a = delta.orphans(lines, "l_orderkey", o, "o_orderkey").groupBy().agg(F.count("*").alias("n")).select(F.lit("line without order").alias("rule"), "n")
    b = delta.orphans(o, "o_orderkey", lines, "l_orderkey").groupBy().agg(F.count("*").alias("n")).select(F.lit("order without line").alias("rule"), "n")
    return a.unionByName(b)


def capped_changes(spark, sf):
    """Fail closed: more changes than the cap give an empty, incomplete list."""
    c = package_delta(spark, sf).where("change <> 'Same'")
    n = c.groupBy("change").agg(F.count("*").alias("n"))
    return n.select("change", (F.col("n") <= 2000).alias("complete"), F.when(F.col("n") <= 2000, F.col("n")).otherwise(0).alias("listed"))


def _reviews(spark, sf):
    c = load(spark, sf, "customer")
    base = c.select("c_custkey", F.col("c_mktsegment").alias("value"))
    r = lambda n, cond, v: base.select("c_custkey", F.lit(n).alias("reviewer"), F.when(cond, v).otherwise(F.col("value")).alias("value"))
    k = F.col("c_custkey")
    return base, r(1, k % 3 == 0, F.lit("NEW")).unionByName(r(2, k % 5 == 0, F.when(k % 2 == 0, "NEW").otherwise("OTHER"))).unionByName(r(3, k % 7 == 0, F.lit("THIRD")))


REVIEWS = """base AS (SELECT c_custkey, c_mktsegment AS value FROM customer), reviews AS (
  SELECT c_custkey, 1 AS reviewer, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE value END AS value FROM base
  UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE 'OTHER' END ELSE value END FROM base
  UNION ALL SELECT c_custkey, 3, CASE WHEN c_custkey % 7 = 0 THEN 'THIRD' ELSE value END FROM base),
t AS (SELECT r.c_custkey, r.reviewer, r.value, b.value AS was FROM reviews r JOIN base b USING (c_custkey) WHERE r.value <> b.value),
g AS (SELECT c_custkey, count(*) AS touchers, count(DISTINCT value) AS results, arg_min(value, reviewer) AS first,
  array_to_string(list_transform(list_filter(list(struct_pack(r := reviewer, v := value) ORDER BY reviewer), lambda x, i: true), lambda x: x.v), '|') AS every FROM t GROUP BY 1)"""


def _merged(policy):
    def run(spark, sf):
        return delta.merge(*_reviews(spark, sf), "c_custkey", policy)

    return run


def merge_conflicts(spark, sf):
    return delta.conflicts(*_reviews(spark, sf), "c_custkey").select("c_custkey", "base_value", F.col("reviewer").cast("long").alias("reviewer"), "value")


def _log(spark, sf):
    """Events as a session log: signups undo, errors redo, the rest are operations."""
    e = load(spark, sf, "events")
    op = F.when(F.col("event_type") == "signup", "undo").when(F.col("event_type") == "error", "redo").otherwise("do")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("event"), op.alias("op"), "event_type", "value")


def batch_atomic(spark, sf):
    s = _log(spark, sf).withColumn("batch", F.floor(F.col("event") / 4))
    return session.batches(s, ["session", "batch"], "event", F.col("event_type") != "error", True).select("session", "event", "applied", "version_steps")


def batch_best_effort(spark, sf):
    s = _log(spark, sf).withColumn("batch", F.floor(F.col("event") / 4))
    return session.batches(s, ["session", "batch"], "event", F.col("event_type") != "error", False).select("session", "event", "applied", "version_steps")


def undo_redo_replay(spark, sf):
    return session.undo_redo(_log(spark, sf))


def undo_redo_invariant(spark, sf):
    """Sessions in which an undo that did something left the stacks other than one down and one up: none."""
    r = session.undo_redo(_log(spark, sf)).join(_log(spark, sf).select("session", "event", "op"), ["session", "event"])
    r.createOrReplaceTempView("quirelake_replay")
    return spark.sql("""SELECT op, count_if(wrong) AS n_wrong FROM (SELECT op, CASE WHEN NOT done THEN undo_depth <> coalesce(u, 0) OR redo_depth <> coalesce(r, 0)
      WHEN op = 'do' THEN redo_depth <> 0 OR undo_depth <> least(50, coalesce(u, 0) + 1) WHEN op = 'undo' THEN undo_depth <> u - 1 OR redo_depth <> r + 1 ELSE undo_depth <> u + 1 OR redo_depth <> r - 1 END AS wrong
      FROM (SELECT *, lag(undo_depth) OVER w AS u, lag(redo_depth) OVER w AS r FROM quirelake_replay WINDOW w AS (PARTITION BY session ORDER BY event))) GROUP BY op""")


def txn_idempotent_dedup(spark, sf):
    l = _log(spark, sf).withColumn("txn", F.col("event") % 97).withColumn("body", F.col("event_type"))
    return session.first_of_transaction(l, ["session", "txn"], "event").select("session", "event", "outcome")


def lineage_chain_validate(spark, sf):
    """A log in which every 50th event claims a wrong state before it, and every 77th a wrong number."""
    e = _log(spark, sf)
    e.createOrReplaceTempView("quirelake_events")
    l = spark.sql("""SELECT session, event, row_number() OVER w - 1 + IF(event % 77 = 0, 1, 0) AS seq, event_type AS after,
      IF(event % 50 = 0, 'wrong', lag(event_type) OVER w) AS before FROM quirelake_events WINDOW w AS (PARTITION BY session ORDER BY event)""")
    return session.lineage(l, "session", "event").groupBy("problem").agg(F.count("*").alias("n"))


def receipt_hash_chain(spark, sf):
    return session.chained(_log(spark, sf), "session", "event", F.concat_ws(":", F.col("event").cast("string"), "op")).select("session", "event", "receipt")


def memory_budget(spark, sf):
    e = _log(spark, sf).withColumn("cost", F.length("event_type").cast("long"))
    return session.budget(e, "session", "event", "cost", 200).where("kept").groupBy("session").agg(F.count("*").alias("n"), F.min("event").alias("oldest"))


QUERIES = {f.__name__: f for f in (package_delta, semantic_changes_ordered, duplicate_key_delta, expectation_bag_diff, expectation_wildcards, finding_disposition, verify_decision, closure_orphans, capped_changes, merge_conflicts, batch_atomic, batch_best_effort, undo_redo_replay, undo_redo_invariant, txn_idempotent_dedup, lineage_chain_validate, receipt_hash_chain, memory_budget)}
QUERIES |= {"three_way_merge_baseWins": _merged("baseWins"), "three_way_merge_firstWins": _merged("firstReviewerWins"), "three_way_merge_stackAll": _merged("stackAll")}

from quirelake.plans.q_blocks import REVISED  # noqa: E402

_LOG = "log AS (SELECT user_id AS session, event_id AS event, CASE event_type WHEN 'signup' THEN 'undo' WHEN 'error' THEN 'redo' ELSE 'do' END AS op, event_type FROM events)"
_MERGE = "WITH " + REVIEWS + """ SELECT b.c_custkey, CASE WHEN touchers IS NULL THEN b.value WHEN results = 1 THEN first ELSE {settled} END AS value,
  CASE WHEN touchers IS NULL THEN 'equal' WHEN touchers = 1 THEN 'single' WHEN results = 1 THEN 'consensus' ELSE 'conflict' END AS status, coalesce(touchers, 0) AS touchers FROM base b LEFT JOIN g USING (c_custkey)"""
_STACK = "(SELECT string_agg(v, '|' ORDER BY r) FROM (SELECT value AS v, min(reviewer) AS r FROM t WHERE t.c_custkey = b.c_custkey GROUP BY value))"
_CLASSES = "WITH " + REVISED + """, n AS (SELECT doc_id, hash, row_number() OVER (PARTITION BY doc_id, hash ORDER BY ord) AS k FROM rev), o AS (SELECT doc_id, hash, row_number() OVER (PARTITION BY doc_id, hash ORDER BY ord) AS k FROM blocks),
  c AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'resolved' ELSE 'preExisting' END AS disposition FROM n FULL JOIN o ON n.doc_id = o.doc_id AND n.hash = o.hash AND n.k = o.k)"""
_DELTA = f"""WITH {CHANGED}, d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'Added' WHEN b.o_orderkey IS NULL THEN 'Removed'
  WHEN a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority THEN 'Same' ELSE 'Modified' END AS change FROM orders a FULL JOIN changed b USING (o_orderkey))"""
ORACLES = {
    "package_delta": _DELTA + " SELECT * FROM d",
    "semantic_changes_ordered": f"""WITH {CHANGED}, a AS (UNPIVOT (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders) ON o_custkey, o_orderstatus, o_orderpriority INTO NAME field VALUE v),
      b AS (UNPIVOT (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM changed) ON o_custkey, o_orderstatus, o_orderpriority INTO NAME field VALUE v),
      c AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.field, b.field) AS field, a.v AS before, b.v AS "after" FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey AND a.field = b.field WHERE a.v IS DISTINCT FROM b.v)
      SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY field NULLS FIRST, before NULLS FIRST, "after" NULLS FIRST) AS nth FROM c""",
    "duplicate_key_delta": """WITH o AS (SELECT l_orderkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linestatus) AS k FROM lineitem),
      x AS (SELECT l_orderkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linestatus) AS line FROM lineitem),
      n AS (SELECT l_orderkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linestatus) AS k FROM x WHERE NOT (l_orderkey % 3 = 0 AND line = 1))
      SELECT CASE WHEN o.k IS NULL THEN 'Added' WHEN n.k IS NULL THEN 'Removed' WHEN o.l_linestatus = n.l_linestatus THEN 'Same' ELSE 'Modified' END AS change, count(*) AS n FROM o FULL JOIN n ON o.l_orderkey = n.l_orderkey AND o.l_returnflag = n.l_returnflag AND o.k = n.k GROUP BY 1""",
    "expectation_bag_diff": """WITH w AS (SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE l_orderkey % 10 <> 1), g AS (SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE l_orderkey % 10 <> 2)
      SELECT side, l_returnflag, count(*) AS n FROM (SELECT 'missing' AS side, * FROM (FROM w EXCEPT ALL FROM g) UNION ALL SELECT 'unexpected', * FROM (FROM g EXCEPT ALL FROM w)) GROUP BY ALL""",
    "expectation_wildcards": """WITH RECURSIVE r(rule, s, p) AS (VALUES (CAST(1 AS BIGINT), NULL, NULL), (2, 'F', NULL), (3, NULL, '1-URGENT'), (4, 'F', '1-URGENT'), (5, 'O', '5-LOW')),
      m AS (SELECT o_orderkey AS id, rule, 10 * (2 - (s IS NOT NULL)::INT - (p IS NOT NULL)::INT) + rule AS cost FROM orders JOIN r ON (s IS NULL OR s = o_orderstatus) AND (p IS NULL OR p = o_orderpriority)),
      n AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT DISTINCT id FROM orders JOIN m ON id = o_orderkey QUALIFY dense_rank() OVER (ORDER BY id) <= 400)),
      g(i, used, id, rule) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) UNION ALL
        SELECT i, list_append(used, coalesce(x, -1)), id, x FROM (SELECT n.i, g.used, n.id, (SELECT arg_min(m.rule, m.cost) FROM m WHERE m.id = n.id AND NOT list_contains(g.used, m.rule)) AS x FROM g JOIN n ON n.i = g.i + 1))
      SELECT id, rule FROM g WHERE rule IS NOT NULL""",
    "finding_disposition": _CLASSES + " SELECT doc_id, disposition, count(*) AS n FROM c GROUP BY ALL",
    "verify_decision": _CLASSES + " SELECT doc_id, CASE WHEN bool_or(disposition = 'new') THEN 'failed' WHEN bool_or(disposition = 'preExisting') THEN 'passedWithPreExisting' ELSE 'passed' END AS decision FROM c GROUP BY 1",
    "closure_orphans": f"WITH {CHANGED} SELECT 'line without order' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM changed) UNION ALL SELECT 'order without line', count(*) FROM changed WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "capped_changes": _DELTA + " SELECT change, count(*) <= 2000 AS complete, CASE WHEN count(*) <= 2000 THEN count(*) ELSE 0 END AS listed FROM d WHERE change <> 'Same' GROUP BY 1",
    "merge_conflicts": "WITH " + REVIEWS + " SELECT t.c_custkey, t.was AS base_value, CAST(t.reviewer AS BIGINT) AS reviewer, t.value FROM t JOIN g USING (c_custkey) WHERE results > 1",
    "batch_atomic": f"WITH {_LOG}, b AS (SELECT session, event, bool_and(event_type <> 'error') OVER (PARTITION BY session, event // 4) AS applied FROM log) SELECT session, event, applied, CAST(applied AS BIGINT) AS version_steps FROM b",
    "batch_best_effort": f"WITH {_LOG} SELECT session, event, event_type <> 'error' AS applied, CAST(bool_or(event_type <> 'error') OVER (PARTITION BY session, event // 4) AS BIGINT) AS version_steps FROM log",
    "undo_redo_invariant": "SELECT * FROM (VALUES ('do', CAST(0 AS BIGINT)), ('undo', 0), ('redo', 0)) t(op, n_wrong)",
    "txn_idempotent_dedup": f"WITH {_LOG} SELECT session, event, CASE WHEN row_number() OVER w = 1 THEN 'applied' WHEN first_value(event_type) OVER w = event_type THEN 'replayed' ELSE 'conflict' END AS outcome FROM log WINDOW w AS (PARTITION BY session, event % 97 ORDER BY event)",
    "lineage_chain_validate": f"""WITH {_LOG}, l AS (SELECT session, event, row_number() OVER w - 1 AS k, row_number() OVER w - 1 + CASE WHEN event % 77 = 0 THEN 1 ELSE 0 END AS seq, lag(event_type) OVER w AS prev, CASE WHEN event % 50 = 0 THEN 'wrong' ELSE lag(event_type) OVER w END AS before FROM log WINDOW w AS (PARTITION BY session ORDER BY event))
      SELECT CASE WHEN seq <> k THEN 'gap' WHEN prev IS NOT NULL AND prev IS DISTINCT FROM before THEN 'broken' END AS problem, count(*) AS n FROM l GROUP BY 1""",
    "receipt_hash_chain": f"WITH {_LOG} SELECT session, event, sha256(string_agg(sha256(event || ':' || op), '') OVER (PARTITION BY session ORDER BY event)) AS receipt FROM log",
    "memory_budget": f"WITH {_LOG}, h AS (SELECT session, event, sum(length(event_type)) OVER (PARTITION BY session ORDER BY event DESC) AS held FROM log) SELECT session, count(*) AS n, min(event) AS oldest FROM h WHERE held <= 200 GROUP BY 1",
    "three_way_merge_baseWins": _MERGE.format(settled="b.value"),
    "three_way_merge_firstWins": _MERGE.format(settled="first"),
    "three_way_merge_stackAll": _MERGE.format(settled=_STACK),
}
