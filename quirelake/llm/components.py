"""Connected components of a graph given by its edges, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import common


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (a, b), by alternating stars.

    A large star links the larger neighbours of each node to its smallest neighbour, a small star the others; one of each
    makes a round, and rounds end when every node hangs on one smaller node that hangs on none. Minima are aggregated
    before they are shuffled, and the joins that bring them back can be split where a node is hot. Nulls and self-loops
    are dropped; repeated edges don't matter; without edges there are no nodes."""
    e = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name, narrow=True)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m")).where("x <> m")
        e = common.materialize(small.select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct(), name, narrow=True)
        parents = e.groupBy("u").agg(F.count("*").alias("n"), F.lit(False).alias("up")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("up")))
        if not parents.groupBy("u").agg(F.max("n").alias("n"), F.max("up").alias("up")).where("n > 1 or (n = 1 and up)").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
