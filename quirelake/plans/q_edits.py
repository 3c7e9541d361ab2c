"""Queries that edit documents, tables, spans and controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import edits
from quirelake.plans.q_blocks import BLOCKS
from quirelake.sources.tables import blocks, load


def _blocks(spark, sf):
    return blocks(load(spark, sf, "documents"))


def _digest(b):
    return b.groupBy("doc_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n"), 256).alias("digest"))


def preconditions_check(spark, sf):
    b = _blocks(spark, sf)
    r = load(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4 * 20).cast("long").alias("ord")).join(b.select("doc_id", "ord", "hash"), ["doc_id", "ord"], "left")
    r = r.select("doc_id", "ord", F.when(F.col("doc_id") % 3 == 0, "bad").otherwise(F.col("hash")).alias("expected_hash"), F.when(F.col("doc_id") % 8 == 4, "nothing").alias("expected_text"))
    return edits.check(r, b).select("doc_id", "ord", "error")


def edit_replace_span(spark, sf):
    r = load(spark, sf, "documents").select("doc_id", F.lit(0).cast("long").alias("ord"), F.lit(2).alias("start"), F.lit(5).alias("end"), F.lit("<new>").alias("new_text"))
    return _digest(edits.replace_span(_blocks(spark, sf), r))


def edit_delete_range(spark, sf):
    r = load(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit(1).cast("long").alias("first"), F.lit(3).cast("long").alias("last"))
    return _digest(edits.delete_ranges(_blocks(spark, sf), r))


def edit_insert(spark, sf):
    r = load(spark, sf, "documents").select("doc_id", F.explode(F.array(F.struct(F.lit(-1).alias("after"), F.lit(0).alias("seq"), F.lit("front").alias("text")), F.struct(F.lit(0).alias("after"), F.lit(2).alias("seq"), F.lit("second").alias("text")), F.struct(F.lit(0).alias("after"), F.lit(1).alias("seq"), F.lit("first").alias("text")))).alias("x")).select("doc_id", "x.*")
    return _digest(edits.insert_blocks(_blocks(spark, sf), r))


def edit_move(spark, sf):
    r = load(spark, sf, "documents").select("doc_id", F.lit(0).cast("long").alias("ord"), F.lit(2).cast("long").alias("after"))
    return _digest(edits.move_blocks(_blocks(spark, sf), r))


def edit_split_merge(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.lit(0).cast("long").alias("ord"), F.lit(4).alias("offset"))
    return _digest(edits.merge_blocks(edits.split_blocks(_blocks(spark, sf), d), d.select("doc_id", F.lit(1).cast("long").alias("ord")), "+"))


def _cells(spark, sf):
    li = load(spark, sf, "orders").select(F.col("o_custkey").alias("tbl"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    from pyspark.sql.window import Window as W

    li = li.withColumn("row", F.row_number().over(W.partitionBy("tbl").orderBy("o_orderkey")))
    return li.select("tbl", "row", F.posexplode(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")).alias("col", "text"))


CELLS = """cells AS (SELECT tbl, r, c - 1 AS c, x[c] AS text FROM (SELECT o_custkey AS tbl, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, [CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority] AS x FROM orders), LATERAL unnest([1, 2, 3]) AS u(c))"""


def table_insert_row(spark, sf):
    c = _cells(spark, sf)
    return edits.insert_row(c, c.select("tbl", F.lit(2).alias("at")).where("tbl % 2 = 0").distinct(), ["tbl"]).select("tbl", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")


def table_delete_column(spark, sf):
    c = _cells(spark, sf)
    return edits.delete_column(c, c.select("tbl", F.lit(1).alias("at")).distinct(), ["tbl"]).select("tbl", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")


def table_merge_cells(spark, sf):
    c = _cells(spark, sf)
    box = c.select("tbl", F.lit(1).alias("top"), F.lit(0).alias("left"), F.lit(2).alias("bottom"), F.lit(1).alias("right")).distinct()
    return edits.merge_cells(c, box, ["tbl"]).select("tbl", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text", "row_span", "col_span")


def annotation_upsert(spark, sf):
    """Labels as annotations, changed by events in order: a user's event puts or removes the annotation of that id."""
    t = load(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    e = load(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "event_type", F.col("event_id"))
    ch = e.select("doc_id", F.col("event_type").alias("value"), "event_id", F.when(F.col("event_type") == "error", "remove").otherwise("put").alias("op"))
    return edits.upsert(t, ch, ["doc_id"], "event_id")


def content_control_fill(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", F.element_at(F.array(*(F.lit(k) for k in ("text", "dropdown", "date", "checkbox"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("kind"), F.lit("old").alias("value"), (F.col("c_custkey") % 5 == 0).alias("locked"), F.array(F.lit("BUILDING"), F.lit("2024-01-31")).alias("items"))
    f = load(spark, sf, "customer").where("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "2024-01-31").when(F.col("c_custkey") % 7 == 1, "true").otherwise(F.col("c_mktsegment")).alias("value"))
    return edits.fill_controls(c, f, ["c_custkey"]).select("c_custkey", "kind", "value", "outcome")


def bookmark_cover(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.lit("intro").alias("name"), F.lit(0).alias("first"), (F.col("doc_id") % 4).alias("last"))
    return edits.bookmarks_over(d, _blocks(spark, sf)).select("doc_id", "name", F.array_join(F.col("ords").cast("array<string>"), ",").alias("ords"))


def image_scale(spark, sf):
    p = load(spark, sf, "part")
    s = edits.scale_image(F.col("p_partkey") + 1000, F.col("p_size").cast("long") * 100, new_width=F.lit(914400).cast("long"))
    return p.select("p_partkey", s["width"].alias("width"), s["height"].alias("height"))


QUERIES = {f.__name__: f for f in (preconditions_check, edit_replace_span, edit_delete_range, edit_insert, edit_move, edit_split_merge, table_insert_row, table_delete_column, table_merge_cells, annotation_upsert, content_control_fill, bookmark_cover, image_scale)}

_END = " SELECT doc_id, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY place)) AS digest FROM e GROUP BY 1"
ORACLES = {
    "preconditions_check": f"""WITH {BLOCKS}, r AS (SELECT d.doc_id, doc_id % 4 * 20 AS ord FROM documents d) SELECT r.doc_id, r.ord, CASE WHEN hash IS NULL THEN 'AnchorNotFound' WHEN r.doc_id % 3 = 0 THEN 'HashMismatch' WHEN r.doc_id % 8 = 4 THEN 'TextMismatch' END AS error FROM r LEFT JOIN blocks b ON b.doc_id = r.doc_id AND b.ord = r.ord""",
    "edit_replace_span": f"WITH {BLOCKS}, e AS (SELECT doc_id, ord AS place, CASE WHEN ord = 0 AND length(text) >= 5 THEN substr(text, 1, 2) || '<new>' || substr(text, 6) ELSE text END AS text FROM blocks)" + _END,
    "edit_delete_range": f"WITH {BLOCKS}, e AS (SELECT doc_id, ord AS place, text FROM blocks WHERE NOT (doc_id % 2 = 0 AND ord BETWEEN 1 AND 3))" + _END,
    "edit_insert": f"WITH {BLOCKS}, e AS (SELECT doc_id, CAST(ord AS DOUBLE) AS place, text FROM blocks UNION ALL SELECT doc_id, -0.5, 'front' FROM documents UNION ALL SELECT doc_id, 0.5, 'first' FROM documents UNION ALL SELECT doc_id, 0.6, 'second' FROM documents)" + _END,
    "edit_move": f"WITH {BLOCKS}, e AS (SELECT doc_id, CASE WHEN ord = 0 THEN 2.5 ELSE ord END AS place, text FROM blocks)" + _END,
    "edit_split_merge": f"""WITH {BLOCKS}, s AS (SELECT doc_id, ord AS p, CASE WHEN ord = 0 AND length(text) > 4 THEN substr(text, 1, 4) ELSE text END AS text FROM blocks UNION ALL SELECT doc_id, 0.5, substr(text, 5) FROM blocks WHERE ord = 0 AND length(text) > 4),
      n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS k, text FROM s), e AS (SELECT doc_id, min(k) AS place, string_agg(text, '+' ORDER BY k) AS text FROM n GROUP BY doc_id, CASE WHEN k = 2 THEN 1 ELSE k END)""" + _END,
    "table_insert_row": f'WITH {CELLS} SELECT tbl, CASE WHEN tbl % 2 = 0 AND r >= 2 THEN r + 1 ELSE r END AS "row", c AS col, text FROM cells UNION ALL SELECT DISTINCT tbl, CAST(2 AS BIGINT), c, \'\' FROM cells WHERE tbl % 2 = 0',
    "table_delete_column": f'WITH {CELLS} SELECT tbl, r AS "row", CASE WHEN c > 1 THEN c - 1 ELSE c END AS col, text FROM cells WHERE c <> 1',
    "table_merge_cells": f"""WITH {CELLS} SELECT tbl, CASE WHEN r <= 2 AND c <= 1 THEN 1 ELSE r END AS "row", CASE WHEN r <= 2 AND c <= 1 THEN 0 ELSE c END AS col, string_agg(text, chr(10) ORDER BY r, c) AS text, count(DISTINCT r) AS row_span, count(DISTINCT c) AS col_span FROM cells GROUP BY 1, 2, 3""",
    "annotation_upsert": """WITH l AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS value FROM events GROUP BY 1) SELECT doc_id, CAST(quality AS VARCHAR) AS value FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT doc_id, value FROM l WHERE value <> 'error'""",
    "content_control_fill": """WITH c AS (SELECT c_custkey, (['text', 'dropdown', 'date', 'checkbox'])[c_custkey % 4 + 1] AS kind, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '2024-01-31' WHEN c_custkey % 7 = 1 THEN 'true' ELSE c_mktsegment END AS v FROM customer),
      o AS (SELECT *, CASE WHEN v IS NULL THEN 'untouched' WHEN c_custkey % 5 = 0 THEN 'locked' WHEN kind = 'dropdown' AND v NOT IN ('BUILDING', '2024-01-31') THEN 'notAnItem' WHEN kind = 'date' AND try_cast(v AS DATE) IS NULL THEN 'badDate' WHEN kind = 'checkbox' AND v NOT IN ('true', 'false') THEN 'badCheckbox' ELSE 'filled' END AS outcome FROM c)
      SELECT c_custkey, kind, CASE WHEN outcome = 'filled' THEN v ELSE 'old' END AS value, outcome FROM o""",
    "bookmark_cover": f"WITH {BLOCKS} SELECT doc_id, 'intro' AS name, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS ords FROM blocks WHERE ord <= doc_id % 4 GROUP BY 1",
    "image_scale": "SELECT p_partkey, CAST(914400 AS BIGINT) AS width, CAST(round(CAST(p_size AS BIGINT) * 100 * 914400 / (p_partkey + 1000)) AS BIGINT) AS height FROM part",
}
