"""Queries on CSS: a style sheet over customers as pages, their orders as divisions and the lines of these as spans, and the
style sheets of the given pages over their own elements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.operators import selectors as S
from quirelake.sources.tables import load

SHEET = """
body { font-family: serif; color: black }
div.O { color: green } div > span.A { color: red; margin: 1 2 }
body.BUILDING span.R { color: blue !important } span { color: inherit }
div.F + div { text-align: right } div.P ~ div.O span { font-weight: bold } div span:first-child { visibility: hidden }
span[data-n="3"] { letter-spacing: 3 } body > span { color: never }
"""


def _tree(spark, sf):
    c, o = load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    l = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    node = lambda df, page, order, line, tag, cls, n: df.select(page.alias("page_id"), order.cast("long").alias("o"), line.cast("long").alias("l"), F.lit(tag).alias("tag"), cls.alias("class"), n.alias("n"))
    none = F.lit(None).cast("long")
    rows = node(c, F.col("c_custkey"), none, none, "body", F.col("c_mktsegment"), none).unionByName(node(o, F.col("o_custkey"), F.col("o_orderkey"), none, "div", F.col("o_orderstatus"), none)).unionByName(
        node(l.join(o, F.col("l_orderkey") == F.col("o_orderkey")), F.col("o_custkey"), F.col("o_orderkey"), F.col("l_linenumber"), "span", F.col("flag"), F.col("l_linenumber").cast("long")))
    here, group = W.partitionBy("page_id").orderBy(F.col("o").asc_nulls_first(), F.col("l").asc_nulls_first()), W.partitionBy("page_id", "o")
    rows = rows.withColumn("pre", (F.row_number().over(here) - 1).cast("long"))
    rows = rows.withColumns({"post": F.when(F.col("tag") == "body", F.max("pre").over(W.partitionBy("page_id"))).when(F.col("tag") == "div", F.max("pre").over(group)).otherwise(F.col("pre")), "div": F.min("pre").over(group)})
    parent = F.when(F.col("tag") == "body", -1).when(F.col("tag") == "div", 0).otherwise(F.col("div"))
    nth = F.row_number().over(W.partitionBy("page_id", "tag", F.when(F.col("tag") == "span", F.col("o"))).orderBy("pre"))
    depth = F.when(F.col("tag") == "body", 0).when(F.col("tag") == "div", 1).otherwise(2)
    return rows.select("page_id", "pre", "post", parent.cast("long").alias("parent"), nth.cast("long").alias("nth"), depth.cast("long").alias("depth"), "tag", F.lit(None).cast("string").alias("id"), F.array("class").alias("classes"),
                       F.when(F.col("n").isNotNull(), F.create_map(F.lit("data-n"), F.col("n").cast("string"))).otherwise(F.expr("cast(map() as map<string,string>)")).alias("attributes"))


def css_selector_matches(spark, sf):
    """How many elements of each page each declaration fits."""
    return S.matches(_tree(spark, sf), S.shared_rules(spark, SHEET)).groupBy("page_id", "rule").agg(F.count("*").alias("n"), F.sum("pre").alias("places"))


def css_computed_values(spark, sf):
    return S.computed(_tree(spark, sf), S.shared_rules(spark, SHEET))


def css_pages_computed(spark, sf):
    """The values of the pages' own elements under their own style sheets and one more rule for list items and links."""
    p = load(spark, sf, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit("<style>nav li + li { color: navy } body { font-family: serif } div > p { text-align: left }</style>")).alias("html"))
    return S.computed(S.elements(p), S.page_rules(p)).groupBy("page_id", "property", "value", "inherited").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (css_selector_matches, css_computed_values, css_pages_computed)}

_TREE = """l AS (
  SELECT l_orderkey AS o, l_linenumber AS n, max(l_returnflag) AS c FROM lineitem GROUP BY ALL
), e AS (
  SELECT c_custkey AS page_id, NULL AS o, NULL AS n, 'body' AS tag, c_mktsegment AS c FROM customer
  UNION ALL SELECT o_custkey, o_orderkey, NULL, 'div', o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT o_custkey, o, n, 'span', c FROM l JOIN orders ON o = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer)
), t AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o NULLS FIRST, n NULLS FIRST) - 1 AS pre, first_value(c) OVER (PARTITION BY page_id ORDER BY o NULLS FIRST, n NULLS FIRST) AS body,
    CASE WHEN tag = 'span' THEN first_value(c) OVER (PARTITION BY page_id, o ORDER BY n NULLS FIRST) END AS div FROM e
), d AS (
  SELECT page_id, o, lag(c) OVER w AS before, coalesce(bool_or(c = 'P') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_p FROM e WHERE tag = 'div' WINDOW w AS (PARTITION BY page_id ORDER BY o)
), x AS (
  SELECT t.*, coalesce(before, '') AS before, coalesce(after_p, false) AS after_p, tag = 'span' AND row_number() OVER (PARTITION BY t.page_id, t.o, tag ORDER BY n) = 1 AS is_first FROM t LEFT JOIN d ON d.page_id = t.page_id AND d.o = t.o
)"""
ORACLES = {
    "css_selector_matches": f"""WITH {_TREE}, m AS (
  SELECT page_id, pre, unnest([CASE WHEN tag = 'body' THEN 0 END, CASE WHEN tag = 'body' THEN 1 END, CASE WHEN tag = 'div' AND c = 'O' THEN 2 END, CASE WHEN tag = 'span' AND c = 'A' THEN 3 END, CASE WHEN tag = 'span' AND c = 'A' THEN 4 END,
    CASE WHEN tag = 'span' AND c = 'A' THEN 5 END, CASE WHEN tag = 'span' AND c = 'A' THEN 6 END, CASE WHEN tag = 'span' AND c = 'A' THEN 7 END, CASE WHEN tag = 'span' AND c = 'R' AND body = 'BUILDING' THEN 8 END, CASE WHEN tag = 'span' THEN 9 END,
    CASE WHEN tag = 'div' AND before = 'F' THEN 10 END, CASE WHEN tag = 'span' AND div = 'O' AND after_p THEN 11 END, CASE WHEN is_first THEN 12 END, CASE WHEN tag = 'span' AND n = 3 THEN 13 END]) AS rule FROM x
)
SELECT page_id, CAST(rule AS BIGINT) AS rule, count(*) AS n, CAST(sum(pre) AS BIGINT) AS places FROM m WHERE rule IS NOT NULL GROUP BY ALL""",
    "css_computed_values": f"""WITH {_TREE}, v AS (
  SELECT page_id, pre, unnest([
    {{'p': 'font-family', 'v': 'serif', 'i': tag <> 'body'}},
    CASE WHEN tag = 'span' AND c = 'R' AND body = 'BUILDING' THEN {{'p': 'color', 'v': 'blue', 'i': false}} WHEN tag = 'span' AND c = 'A' THEN {{'p': 'color', 'v': 'red', 'i': false}}
      WHEN tag = 'div' AND c = 'O' THEN {{'p': 'color', 'v': 'green', 'i': false}} WHEN tag = 'span' AND div = 'O' THEN {{'p': 'color', 'v': 'green', 'i': true}} ELSE {{'p': 'color', 'v': 'black', 'i': tag <> 'body'}} END,
    CASE WHEN tag = 'span' AND c = 'A' THEN {{'p': 'margin-top', 'v': '1', 'i': false}} END, CASE WHEN tag = 'span' AND c = 'A' THEN {{'p': 'margin-bottom', 'v': '1', 'i': false}} END,
    CASE WHEN tag = 'span' AND c = 'A' THEN {{'p': 'margin-left', 'v': '2', 'i': false}} END, CASE WHEN tag = 'span' AND c = 'A' THEN {{'p': 'margin-right', 'v': '2', 'i': false}} END,
    CASE WHEN before = 'F' THEN {{'p': 'text-align', 'v': 'right', 'i': tag = 'span'}} END, CASE WHEN tag = 'span' AND div = 'O' AND after_p THEN {{'p': 'font-weight', 'v': 'bold', 'i': false}} END,
    CASE WHEN is_first THEN {{'p': 'visibility', 'v': 'hidden', 'i': false}} END, CASE WHEN tag = 'span' AND n = 3 THEN {{'p': 'letter-spacing', 'v': '3', 'i': false}} END]) AS x FROM x
)
SELECT page_id, pre, x.p AS property, x.v AS value, x.i AS inherited FROM v WHERE x IS NOT NULL""",
}
