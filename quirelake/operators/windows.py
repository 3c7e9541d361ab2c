"""Ordered operators: islands, running folds, depths, gaps, as-of lookups, monotone bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _up_to(key: list[str], order: list, last: int = 0):
    return W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, last)


def islands(df: DataFrame, key: list[str], order: list, value: Column, name: str = "island") -> DataFrame:
    """Number the runs of equal adjacent values from 1; nulls are equal to each other."""
    w = W.partitionBy(*key).orderBy(*order)
    change = F.when((F.row_number().over(w) == 1) | ~value.eqNullSafe(F.lag(value).over(w)), 1).otherwise(0)
    return df.withColumn("__change", change).withColumn(name, F.sum("__change").over(_up_to(key, order)).cast("long")).drop("__change")


def running(df: DataFrame, key: list[str], order: list, fold: Column, name: str, last: int = 0) -> DataFrame:
    """A running aggregate up to the current row (last=-1: up to the row before)."""
    return df.withColumn(name, fold.over(_up_to(key, order, last)))


def depth(df: DataFrame, key: list[str], order: list, opens: Column, closes: Column, name: str = "depth") -> DataFrame:
    """Nesting depth of begin and end marks: a begin and its end have the same depth, from 1."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    return df.withColumn("__step", step).withColumn(name, (F.sum("__step").over(_up_to(key, order)) + F.when(closes, 1).otherwise(0)).cast("long")).drop("__step")


def preceding(df: DataFrame, key: list[str], order: list, value: Column, name: str, last: int = 0) -> DataFrame:
    """As-of lookup: the last non-null value at or before each row (last=-1: before)."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_up_to(key, order, last)))


def following(df: DataFrame, key: list[str], order: list, value: Column, name: str, first: int = 0) -> DataFrame:
    """The first non-null value at or after each row (first=1: after)."""
    return df.withColumn(name, F.first(value, ignorenulls=True).over(W.partitionBy(*key).orderBy(*order).rowsBetween(first, W.unboundedFollowing)))


def monotone_bounds(df: DataFrame, key: list[str], order: list, value: Column) -> DataFrame:
    """high: the largest value before each row; low: the smallest after it. A pair crosses none of the others if its
    value lies between."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("high", F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("low", F.min(value).over(w.rowsBetween(1, W.unboundedFollowing)))
