"""Deltas of two versions of a keyed table, expectations, findings and their decision."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.sources.store import stored


def delta(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, change (Added, Removed, Modified, Same), old_digest, new_digest; values are compared by a null-safe digest."""
    # as bytes, half of their digits, until both have met: the join sorts them
    digest = lambda df, name: df.select(*keys, F.unhex(F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)).alias(name))
    both = digest(old, "old_digest").join(digest(new, "new_digest"), keys, "full")
    change = F.when(F.col("old_digest").isNull(), "Added").when(F.col("new_digest").isNull(), "Removed").when(F.col("old_digest") == F.col("new_digest"), "Same").otherwise("Modified")
    return both.withColumns({"change": change, **{c: F.lower(F.hex(c)) for c in ("old_digest", "new_digest")}})


def field_changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, field, before, after for every field that differs; a row on one side alone has all its fields."""
    long = lambda df, name: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(v).alias("field"), F.col(v).cast("string").alias("v")) for v in values))).alias("f")).select(*keys, "f.field", F.col("f.v").alias(name), F.lit(True).alias(f"has_{name}"))
    both = long(old, "before").join(long(new, "after"), [*keys, "field"], "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")) | F.col("has_before").isNull() | F.col("has_after").isNull()).drop("has_before", "has_after")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """Number duplicates of a key in sorted order from 0, so that bags can be joined."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def bag_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one bag that the other lacks, as often as it lacks them: side (missing, unexpected) and the row."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def expect(actual: DataFrame, expectations: DataFrame, fields: list[str]) -> DataFrame:
    """Match actual rows (id, fields) with expectations (rule, fields, null as a wildcard), each used once: in the order of
    their ids, rows take the most specific rule that is left, the smallest one on a tie. Rows: id, rule (null if none).

    Rules with the same wildcards meet rows in one equi-join over their other fields. Rules are few. In rounds every row asks for its best rule; a rule promised to a row is closed to those with larger ids,
    so a round only tells the smallest id that asks for each rule, found by aggregation. No rule gathers its rows in one
    task, and rounds end when no promise changes."""
    met = None
    masks = expectations.select(F.array(*[F.col(f).isNotNull() for f in fields]).alias("m")).distinct().collect()
    for mask in (r["m"] for r in masks):
        known = [f for f, there in zip(fields, mask, strict=True) if there]
        rules = expectations.where(reduce(and_, [F.col(f).isNotNull() if f in known else F.col(f).isNull() for f in fields])).select("rule", *known)
        # a rule without any field fits all rows: it needs no key, and is offered by one row each
        found = actual.join(rules, known) if known else actual.withColumn("rule", F.explode(F.array(*[F.lit(r["rule"]) for r in rules.orderBy("rule").collect()])))
        found = found.select("id", "rule", F.lit(-len(known)).alias("rank"))
        met = found if met is None else met.unionByName(found)
    if met is None:
        return actual.select("id", F.lit(None).cast(dict(expectations.dtypes)["rule"]).alias("rule"))
    met = stored(met, "expect-met")
    kinds, promised = dict(met.dtypes), {}
    while True:
        held = actual.sparkSession.createDataFrame([(r, i) for r, i in promised.items()], f"rule {kinds['rule']}, held {kinds['id']}")
        asks = met.join(F.broadcast(held), "rule", "left").where("held is null or id <= held").groupBy("id").agg(F.min(F.struct("rank", "rule")).alias("best"))
        now = {r["rule"]: r["id"] for r in asks.groupBy(F.col("best.rule").alias("rule")).agg(F.min("id").alias("id")).collect()}
        if now == promised:
            return actual.select("id").join(F.broadcast(held.select(F.col("held").alias("id"), "rule")), "id", "left")
        promised = now


def classify(current: DataFrame, baseline: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Findings as new, preExisting or resolved: duplicates of an identity are numbered in order and joined."""
    c, b = numbered(current.select(*identity, *order), identity, order), numbered(baseline.select(*identity, *order), identity, order)
    both = c.select(*identity, "occurrence", F.lit(True).alias("now")).join(b.select(*identity, "occurrence", F.lit(True).alias("then")), [*identity, "occurrence"], "full")
    return both.select(*identity, "occurrence", F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("preExisting").alias("disposition"))


def decide(classified: DataFrame, key: list[str], blocking) -> DataFrame:
    """passed, passedWithPreExisting or failed for each key: a new blocking finding fails it."""
    g = classified.groupBy(*key).agg(F.bool_or((F.col("disposition") == "new") & blocking).alias("fails"), F.bool_or(F.col("disposition") == "preExisting").alias("old"))
    return g.select(*key, F.when(F.col("fails"), "failed").when(F.col("old"), "passedWithPreExisting").otherwise("passed").alias("decision"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def canonical_order(changes: DataFrame, columns: list[str], within: list[str]) -> DataFrame:
    """Number changes in canonical order (nulls first) inside each part."""
    return changes.withColumn("nth", F.row_number().over(W.partitionBy(*within).orderBy(*(F.col(c).asc_nulls_first() for c in columns))).cast("long"))


def merge(base: DataFrame, reviews: DataFrame, key: str, policy: str) -> DataFrame:
    """N-way merge of field edits. base: key, value; reviews: key, reviewer, value (one row for each reviewer's version).

    A reviewer touches a key by another value than the base's. Untouched: the base; one toucher or equal results: that
    result; else a conflict, which the policy settles: baseWins, firstReviewerWins (the smallest reviewer) or stackAll
    (all distinct results in reviewer order, joined by a bar). Rows: key, value, status, touchers."""
    touched = reviews.join(base.select(key, F.col("value").alias("was")), key).where(~F.col("value").eqNullSafe(F.col("was")))
    g = touched.groupBy(key).agg(F.count("*").alias("touchers"), F.countDistinct(F.coalesce("value", F.lit("\u0000"))).alias("results"), F.min_by("value", "reviewer").alias("first"), F.array_sort(F.collect_list(F.struct("reviewer", "value"))).alias("all"))
    out = base.join(g, key, "left")
    stacked = F.array_join(F.array_distinct(F.transform("all", lambda x: x["value"])), "|")
    settled = {"baseWins": F.col("value"), "firstReviewerWins": F.col("first"), "stackAll": stacked}[policy]
    value = F.when(F.col("touchers").isNull(), F.col("value")).when(F.col("results") == 1, F.col("first")).otherwise(settled)
    status = F.when(F.col("touchers").isNull(), "equal").when(F.col("touchers") == 1, "single").when(F.col("results") == 1, "consensus").otherwise("conflict")
    return out.select(key, value.alias("value"), status.alias("status"), F.coalesce("touchers", F.lit(0)).cast("long").alias("touchers"))


def conflicts(base: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """One row per conflicting key and reviewer: key, base value, reviewer, value."""
    bad = merge(base, reviews, key, "baseWins").where("status = 'conflict'").select(key, F.col("value").alias("base_value"))
    return reviews.join(bad, key).where(~F.col("value").eqNullSafe(F.col("base_value"))).select(key, "base_value", "reviewer", "value")
