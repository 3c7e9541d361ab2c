"""Queries on packages as graphs of parts: a customer is a package of orders, lines and the media they share."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import package
from quirelake.sources.store import stored
from quirelake.sources.tables import load


def _packages(spark, sf):
    """(parts, relations) of two versions. In the new one each eleventh order is gone with its lines, each thirteenth has
    another part name, the second line of each seventh is changed, the first of
    each seventeenth asks for media that isn't there, and each fifth customer has one more order."""
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    o = o.join(c.select("c_custkey"), "c_custkey", "left_semi").dropDuplicates(["o_orderkey"])
    l = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("mode"))
    l = stored(l.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "lines")
    k = F.col("o_orderkey")
    order, line = F.concat(F.lit("order/"), k.cast("string")), F.concat(F.lit("line/"), k.cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    media = F.concat(F.lit("media/"), "mode")
    gone, renamed, swapped, changed = k % 11 == 0, (k % 13 == 0) & (k % 7 != 0) & (k % 17 != 0), (k % 17 == 0) & (F.col("l_linenumber") == 1), (k % 7 == 0) & (F.col("l_linenumber") == 2)
    part = lambda df, p, kind, content: df.select(F.col("c_custkey").alias("package"), p.alias("part"), F.lit(kind).alias("kind"), content.alias("content"))
    link = lambda df, s, name, t: df.select(F.col("c_custkey").alias("package"), s.alias("source"), name.alias("name"), t.alias("target"))
    shared = part(l.select("c_custkey", "mode").distinct(), media, "media", F.col("mode"))
    root = part(c, F.lit("root"), "package", F.col("c_mktsegment"))

    def version(new: bool):
        oo, ll = (o.where(~gone), l.where(~gone)) if new else (o, l)
        name = F.when(renamed, F.concat(order, F.lit("-b"))).otherwise(order) if new else order
        content = F.when(changed, F.concat("flag", F.lit("!"))).otherwise(F.col("flag")) if new else F.col("flag")
        parts = root.unionByName(part(oo, name, "order", F.concat(order, "o_orderstatus"))).unionByName(part(ll, line, "line", content)).unionByName(shared)
        links = link(oo, F.lit("root"), order, name).unionByName(link(ll, name, line, line)).unionByName(link(ll, line, F.lit("media"), F.when(swapped, "media/none").otherwise(media) if new else media))
        if new:
            more = c.where("c_custkey % 5 = 0")
            parts = parts.unionByName(part(more, F.lit("order/new"), "order", F.lit("new"))).unionByName(part(more, F.lit("line/new/1"), "line", F.lit("new")))
            links = links.unionByName(link(more, F.lit("root"), F.lit("order/new"), F.lit("order/new"))).unionByName(link(more, F.lit("order/new"), F.lit("line/new/1"), F.lit("line/new/1")))
        return parts, links

    return version(False), version(True)


def package_graph_changes(spark, sf):
    return package.package_changes(*_packages(spark, sf))


def package_digests_equal(spark, sf):
    """How many parts of each kind have the same digest in both versions, and how many of those that are in both don't."""
    both, _, _ = package.compared(*_packages(spark, sf))
    return both.where("equal is not null").groupBy(F.col("old_kind").alias("kind")).agg(F.count_if("equal").alias("equal"), F.count_if(~F.col("equal")).alias("different"))


QUERIES = {f.__name__: f for f in (package_graph_changes, package_digests_equal)}

_PACKAGES = """o AS (
  SELECT DISTINCT ON (o_orderkey) o_orderkey AS k, o_custkey AS c FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
), l AS (
  SELECT DISTINCT c, k, l_linenumber AS n FROM lineitem JOIN o ON l_orderkey = k
), x AS (
  SELECT *, k % 11 = 0 AS gone, k % 13 = 0 AND k % 7 <> 0 AND k % 17 <> 0 AS renamed, k % 17 = 0 AND EXISTS (SELECT 1 FROM l WHERE l.k = o.k AND n = 1) AS swapped, k % 7 = 0 AND EXISTS (SELECT 1 FROM l WHERE l.k = o.k AND n = 2) AS changed FROM o
)"""
ORACLES = {
    "package_graph_changes": f"""WITH {_PACKAGES}
SELECT c AS package, 'line/' || k || '/2' AS part, 'modified' AS change, 'line' AS kind FROM x WHERE changed AND NOT gone
UNION ALL SELECT c, 'order/' || k, 'removed', 'order' FROM x WHERE gone
UNION ALL SELECT c, 'root#order/' || k, 'relationRemoved', 'package' FROM x WHERE gone
UNION ALL SELECT c, 'order/' || k || '-b', 'renamed', 'order' FROM x WHERE renamed AND NOT gone
UNION ALL SELECT c, 'line/' || k || '/1#media', 'retargeted', 'line' FROM x WHERE swapped AND NOT gone
UNION ALL SELECT c_custkey, 'order/new', 'added', 'order' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'root#order/new', 'relationAdded', 'package' FROM customer WHERE c_custkey % 5 = 0""",
    "package_digests_equal": f"""WITH {_PACKAGES}, p AS (
  SELECT 'line' AS kind, NOT (k % 7 = 0 AND n = 2) AND NOT (k % 17 = 0 AND n = 1) AS same FROM l WHERE k % 11 <> 0
  UNION ALL SELECT 'order', NOT changed AND NOT swapped FROM x WHERE NOT gone AND NOT renamed
  UNION ALL SELECT 'media', true FROM (SELECT DISTINCT c, m FROM (SELECT c, k, l_linenumber, max(l_linestatus) AS m FROM lineitem JOIN o ON l_orderkey = k GROUP BY ALL))
  UNION ALL SELECT 'package', c_custkey % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM x WHERE x.c = c_custkey AND (gone OR changed OR swapped)) FROM customer
)
SELECT kind, count(*) FILTER (same) AS equal, count(*) FILTER (NOT same) AS different FROM p GROUP BY kind""",
}
