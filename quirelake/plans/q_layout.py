"""Queries on layout, affixes, splits, table differences and scalar kernels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.functions import text as T
from quirelake.operators import align, layout, windows
from quirelake.plans.q_blocks import BLOCKS, REVISED
from quirelake.sources.tables import blocks, load, revised


def text_widths(spark, sf):
    b = blocks(load(spark, sf, "documents"))
    return b.groupBy("doc_id").agg(F.round(F.max(layout.text_width(F.col("text"))), 4).alias("widest"))


def font_classes(spark, sf):
    d = load(spark, sf, "documents").select("lang", F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("lang", "c").agg(F.count("*").alias("n"))
    code = F.ascii("c")
    kind = F.when(code < 128, "ascii").when((code >= 0x590) & (code <= 0x7FF), "cs").when(((code >= 0x2E80) & (code <= 0x9FFF)) | ((code >= 0xAC00) & (code <= 0xD7AF)), "eastAsia").otherwise("hAnsi")
    return d.groupBy("lang", kind.alias("kind")).agg(F.sum("n").alias("n"))


def trimmed_affixes(spark, sf):
    """Each block against itself with its third word replaced."""
    b = blocks(load(spark, sf, "documents")).where("text rlike '^[^ ]+ [^ ]+ [^ ]+ '")
    t = layout.trimmed(F.col("text"), F.regexp_replace("text", "^([^ ]+ [^ ]+) [^ ]+ ", "$1 <word> "))
    return b.select("doc_id", "ord", t["left"].alias("left_text"), t["right"].alias("right_text"))


def page_flow(spark, sf):
    f = layout.page_flow(blocks(load(spark, sf, "documents")), "doc_id")
    return f.groupBy("doc_id").agg(F.max("page").alias("last_page"), F.count("*").alias("n"))


def split_blocks_found(spark, sf):
    """Blocks of twelve words or more are split in two; the splits are found again."""
    b = blocks(load(spark, sf, "documents")).where(F.size(T.words(F.col("text"))) >= 12).select("doc_id", "ord", "text")
    half = F.floor(F.size(F.split("text", " ")) / 2).cast("int")
    w = F.split("text", " ")
    parts = b.select("doc_id", "ord", F.posexplode(F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))).alias("p", "text"))
    parts = parts.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("ord", "p")).cast("long")).drop("p")
    return layout.splits(b, parts)


def table_row_diff(spark, sf):
    """Orders of a customer as table rows against a version with a changed status in every 5th order, every 7th gone."""
    o = load(spark, sf, "orders")
    old = o.select("o_custkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("row"), F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("cells"))
    n = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    new = n.select("o_custkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("row"), F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("cells"))
    return layout.table_diff(old, new, ["o_custkey"]).groupBy("op").agg(F.count("*").alias("n"))


def monotone_pairs(spark, sf):
    """Anchor pairs that cross none of the others."""
    left = blocks(load(spark, sf, "documents"))
    p = align.unique_hash_join(left, revised(left)).select("doc_id", "left_ord", "right_ord")
    m = windows.monotone_bounds(p, ["doc_id"], ["left_ord"], F.col("right_ord"))
    return m.where("coalesce(high < right_ord, true) and coalesce(low > right_ord, true)").select("doc_id", "left_ord", "right_ord")


def localized_ordinals(spark, sf):
    n = F.col("p_size").cast("long")
    return load(spark, sf, "part").select("p_partkey", *(layout.ordinal_in(n, x).alias(f"ordinal_{x}") for x in ("fr", "de", "sv", "zh")))


def batch_change_sets(spark, sf):
    """Labels before and after an edit, by id and serialized form."""
    a = load(spark, sf, "labels")
    b = a.where("doc_id % 6 <> 0").withColumn("toxic", F.when(F.col("doc_id") % 4 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    j = lambda df, name: df.select("doc_id", F.to_json(F.struct("quality", "toxic")).alias(name))
    both = j(a, "x").join(j(b, "y"), "doc_id", "full")
    return both.select("doc_id", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "modified").otherwise("same").alias("change"))


def calendar_dates(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "MMMM").alias("month_name"), F.dayofmonth("o_orderdate").cast("long").alias("day"), F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), F.date_format("o_orderdate", "MMMM yyyy")).alias("label"))


QUERIES = {f.__name__: f for f in (text_widths, font_classes, trimmed_affixes, page_flow, split_blocks_found, table_row_diff, monotone_pairs, localized_ordinals, batch_change_sets, calendar_dates)}

ORACLES = {
    "text_widths": f"""WITH {BLOCKS}, w AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[ijlt.,:;!''| ]')) AS a, len(regexp_extract_all(text, '[mwMW@%]')) AS b FROM blocks) SELECT doc_id, round(max((a * 0.28::DOUBLE + b * 0.85::DOUBLE + (n - a - b) * 0.55::DOUBLE) * 11), 4) AS widest FROM w GROUP BY 1""",
    "font_classes": """SELECT lang, CASE WHEN unicode(c) < 128 THEN 'ascii' WHEN unicode(c) BETWEEN 1424 AND 2047 THEN 'cs' WHEN unicode(c) BETWEEN 11904 AND 40959 OR unicode(c) BETWEEN 44032 AND 55215 THEN 'eastAsia' ELSE 'hAnsi' END AS kind, count(*) AS n
      FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL""",
    "trimmed_affixes": f"""WITH {BLOCKS} SELECT doc_id, ord, string_split(text, ' ')[3] AS left_text, '<word>' AS right_text FROM blocks WHERE regexp_matches(text, '^[^ ]+ [^ ]+ [^ ]+ ')""",
    "table_row_diff": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 7 <> 0),
      c AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) AS old_left, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0) AS new_left, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0) AS same FROM orders GROUP BY 1)
      SELECT * FROM (SELECT 'Equal' AS op, CAST(sum(same) AS BIGINT) AS n FROM c UNION ALL SELECT 'Modified', CAST(sum(least(old_left, new_left)) AS BIGINT) FROM c UNION ALL SELECT 'Deleted', CAST(sum(greatest(old_left - new_left, 0)) AS BIGINT) FROM c UNION ALL SELECT 'Inserted', CAST(sum(greatest(new_left - old_left, 0)) AS BIGINT) FROM c) WHERE n > 0""",
    "monotone_pairs": f"""WITH {REVISED}, m AS (SELECT doc_id, left_ord, right_ord, max(right_ord) OVER (PARTITION BY doc_id ORDER BY left_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi, min(right_ord) OVER (PARTITION BY doc_id ORDER BY left_ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lo FROM pairs)
      SELECT doc_id, left_ord, right_ord FROM m WHERE coalesce(hi < right_ord, true) AND coalesce(lo > right_ord, true)""",
    "localized_ordinals": """SELECT p_partkey, CASE WHEN p_size = 1 THEN '1er' ELSE p_size || 'e' END AS ordinal_fr, p_size || '.' AS ordinal_de, p_size || CASE WHEN p_size % 10 IN (1, 2) AND p_size % 100 NOT IN (11, 12) THEN ':a' ELSE ':e' END AS ordinal_sv, '第' || p_size AS ordinal_zh FROM part""",
    "batch_change_sets": "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'removed' WHEN doc_id % 4 = 0 THEN 'modified' ELSE 'same' END AS change FROM labels",
    "calendar_dates": "SELECT o_orderkey, monthname(o_orderdate) AS month_name, day(o_orderdate) AS day, day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) AS label FROM orders",
}
