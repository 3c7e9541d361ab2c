"""Queries over tables as sheets: scans, ranges, formats, pivots, metrics, grids, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.functions import numbers as N
from quirelake.operators import sheet, windows
from quirelake.sources.tables import blocks, load, row_numbers, sparse_cells

NATION = ["n_nationkey", "n_name", "n_regionkey"]
SUPPLIER = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def sheet_sparse_cells(spark, sf):
    return sparse_cells(load(spark, sf, "nation"), ["n_nationkey"], NATION)


def range_scan(spark, sf):
    return sheet.scan_range(sparse_cells(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderstatus"]), "B3:C12").select("ref", "value")


def typed_cells(spark, sf):
    c = sheet.typed(sparse_cells(load(spark, sf, "supplier"), ["s_suppkey"], SUPPLIER))
    return c.groupBy("col").agg(F.count("number").alias("n_numbers"), F.count("text").alias("n_texts"), F.round(F.sum("number"), 2).alias("total"))


def a1_codec(spark, sf):
    p = load(spark, sf, "part").select("p_partkey").where("p_partkey <= 18278")
    a = N.column_letters(F.col("p_partkey"))
    return p.select("p_partkey", a.alias("letters"), N.column_index(a).alias("back"))


def table_by_header(spark, sf):
    c = sparse_cells(load(spark, sf, "supplier"), ["s_suppkey"], SUPPLIER)
    return sheet.by_header(c, SUPPLIER).select("row", F.col("s_suppkey").try_cast("bigint").alias("s_suppkey"), "s_name", F.col("s_nationkey").try_cast("bigint").alias("s_nationkey"))


def missing_address_repair(spark, sf):
    """Cells of orders' first three columns, one in three without its column number."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pos"))
    o = o.withColumn("col", F.when((F.col("row") + F.col("pos")) % 3 != 0, F.col("pos") + 4))
    return sheet.repaired(o).groupBy("pos", "col").agg(F.count("*").alias("n"))


def cell_format_codes(spark, sf):
    x = F.col("c_acctbal")
    return load(spark, sf, "customer").select("c_custkey", N.cell_text("#,##0.00;(#,##0.00)", x).alias("money"), N.cell_text("0", x).alias("whole"), N.cell_text("0.0%", x / 10000).alias("percent"), N.cell_text("0.00;-0.00;0;@", x).alias("four"))


def ole_dates(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", N.to_ole(F.col("o_orderdate").cast("timestamp")).alias("serial"))
    return o.select("o_orderkey", F.round("serial", 6).alias("serial"), F.date_format(N.ole_date(F.col("serial") + 0.25), "yyyy-MM-dd HH:mm:ss").alias("six_hours_on"))


def number_formats(spark, sf):
    """List numbers up to 4,999 in all formats, and number words up to 19,999."""
    n, wide = (F.col("p_partkey") * 7 % 4999 + 1).cast("long"), (F.col("p_partkey") * 11 % 19999 + 1).cast("long")
    names = {"decimal": "decimal", "decimalZero": "decimalZero", "upperRoman": "upperRoman", "lowerLetter": "lowerLetter", "ordinal": "ordinal", "padded4": "0001, 0002, 0003, ...", "circle": "decimalEnclosedCircle", "bullet": "bullet"}
    return load(spark, sf, "part").select("p_partkey", *(N.list_number(n, k).alias(a) for a, k in names.items()), *(N.list_number(wide, k).alias(k) for k in ("cardinalText", "ordinalText")))


def unit_lengths(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.element_at(F.array(*(F.lit(u) for u in ("pt", "px", "in", "cm", "mm", "pc", "em"))), (F.col("p_partkey") % 7 + 1).cast("int")).alias("unit"))
    return p.select("p_partkey", "unit", F.round(N.twips(F.col("x"), F.col("unit")), 4).alias("twips"), F.array_join(N.rgb(F.concat(F.lit("#"), F.lpad(F.lower(F.hex("p_partkey")), 6, "0"))), ",").alias("rgb"))


def pivot_sum(spark, sf):
    return sheet.pivot(load(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("decimal(18,2)")), ["l_returnflag"], "l_linestatus", ["F", "O"], {"q": "sum"}).select("l_returnflag", F.col("F_sum_q").cast("double").alias("sum_f"), F.col("O_sum_q").cast("double").alias("sum_o"))


def pivot_multi_value(spark, sf):
    o = load(spark, sf, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    p = sheet.pivot(o, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], {"price": "sum", "o_custkey": "count"})
    return p.select("o_orderpriority", *(F.col(f"{s}_sum_price").cast("double").alias(f"sum_{s.lower()}") for s in "FOP"), *(F.col(f"{s}_count_o_custkey").alias(f"n_{s.lower()}") for s in "FOP"))


def pivot_cache_facts(spark, sf):
    return sheet.cache_facts(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"), "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"])


def column_metrics(spark, sf):
    out = None
    for name in ("region", "nation", "customer", "supplier", "part"):
        t = load(spark, sf, name)
        one = t.agg(*(F.struct(F.count(c).alias("n"), F.countDistinct(c).alias("d")).alias(c) for c in t.columns))
        one = one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(c)["n"].alias("n"), F.col(c)["d"].alias("n_distinct")) for c in t.columns))).alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    return out


def distinct_sorted_lists(spark, sf):
    return load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


def document_metrics(spark, sf):
    b = blocks(load(spark, sf, "documents"))
    return b.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.count_if(F.trim("text") == "").alias("n_blank"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.floor(F.sum(F.length("text")) / F.count("*")).cast("long").alias("average_length"))


def content_type_counts(spark, sf):
    """The first rule that matches classifies a block; blocks are counted by class."""
    b = blocks(load(spark, sf, "documents"))
    t = F.col("text")
    kind = F.when(F.trim(t) == "", "blank").when(t.rlike("^[A-Z][^.]*$"), "title").when(t.rlike("[0-9]"), "numeric").when(F.length(t) > 200, "long").otherwise("body")
    return b.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def list_numbering_multilevel(spark, sf):
    """Regions and nations as a two-level list: counters, the second level starts again under each region."""
    r, n = load(spark, sf, "region").select("r_regionkey", "r_name"), load(spark, sf, "nation").select("n_regionkey", "n_name")
    a = F.row_number().over(W.orderBy("r_name"))  # five regions
    top = r.select("r_regionkey", "r_name", a.alias("level0"))
    low = n.join(top, n["n_regionkey"] == top["r_regionkey"]).select("level0", "n_name", F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_name")).alias("level1"))
    text = F.concat(N.list_number(F.col("level0").cast("long"), "upperRoman"), F.lit("."), N.list_number(F.col("level1").cast("long"), "lowerLetter"), F.lit(")"))
    return top.select(F.col("r_name").alias("item"), F.concat(N.roman(F.col("level0").cast("long")), F.lit(".")).alias("label")).unionByName(low.select(F.col("n_name").alias("item"), text.alias("label")))


def page_number_sequence(spark, sf):
    """Page numbers that start again in each section: five documents' blocks to a page, sections by source."""
    b = blocks(load(spark, sf, "documents").select("doc_id", "text", "source")).groupBy("doc_id").agg(F.count("*").alias("n"))
    d = load(spark, sf, "documents").select("doc_id", "source").join(b, "doc_id")
    page = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return d.select("doc_id", "source", page.cast("long").alias("page"), N.list_number(page.cast("long"), "decimal").alias("label"))


def table_grid(spark, sf):
    """Order lines as table rows of cells with spans; the return flag merges downwards."""
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tbl"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).cast("long").alias("row"), "l_returnflag")
    same = F.lag("l_returnflag").over(W.partitionBy("tbl").orderBy("row")) == F.col("l_returnflag")
    li = li.withColumn("m", F.when(same, "continue").otherwise("restart"))
    c = li.select("tbl", "row", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("span"), F.col("m").alias("v_merge")), F.struct(F.lit(1).cast("long").alias("pos"), F.lit(2).cast("long").alias("span"), F.lit(None).cast("string").alias("v_merge")))).alias("c")).select("tbl", "row", "c.*")
    g = sheet.grid(c, ["tbl"])
    return g.groupBy("tbl").agg(F.max(F.col("grid_start") + F.col("span")).alias("n_columns"), F.count_if(F.col("covering_row") < F.col("row")).alias("n_covered"), F.max(F.col("row") - F.col("covering_row")).alias("deepest"))


def nested_marker_depth(spark, sf):
    """Begin and end marks (clicks open, errors close) per user: depth of each, and orphans."""
    e = load(spark, sf, "events").select("user_id", "event_id", "event_type")
    e = windows.depth(e, ["user_id"], ["event_id"], F.col("event_type") == "click", F.col("event_type") == "error")
    return e.where(F.col("event_type").isin("click", "error")).select("user_id", "event_id", "event_type", "depth", ((F.col("event_type") == "error") & (F.col("depth") < 1)).alias("orphan"))


def ordered_row_numbers(spark, sf):
    return row_numbers(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_no")


def note_id_order(spark, sf):
    """Numeric ids before text ids."""
    p = load(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("n"), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_suppkey").cast("string")).alias("id"), "s_nationkey")
    w = W.partitionBy("s_nationkey").orderBy(F.col("id").try_cast("int").asc_nulls_last(), "id")
    return p.select("id", "s_nationkey", F.row_number().over(w).cast("long").alias("nth"))


QUERIES = {f.__name__: f for f in (sheet_sparse_cells, range_scan, typed_cells, a1_codec, table_by_header, missing_address_repair, cell_format_codes, ole_dates, number_formats, unit_lengths, pivot_sum, pivot_multi_value, pivot_cache_facts, column_metrics, distinct_sorted_lists, document_metrics, content_type_counts, list_numbering_multilevel, page_number_sequence, table_grid, nested_marker_depth, ordered_row_numbers, note_id_order)}

from quirelake.plans.q_blocks import BLOCKS  # noqa: E402

_CELLS = {
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}
_LETTERS = "(CASE WHEN {0} >= 703 THEN chr(CAST((({0} - 703) // 676) + 65 AS INTEGER)) ELSE '' END || CASE WHEN {0} >= 27 THEN chr(CAST(((({0} - 27) // 26) % 26) + 65 AS INTEGER)) ELSE '' END || chr(CAST((({0} - 1) % 26) + 65 AS INTEGER)))"
_ROMAN = "(['', 'M', 'MM', 'MMM', 'MMMM'])[{0} // 1000 + 1] || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[{0} // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[{0} // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[{0} % 10 + 1]"
_ONES = str(list(N.ONES))
_ORD = str(list(N.ORDINALS))
_TENS = str(list(N.TENS))
ORACLES = {
    "sheet_sparse_cells": "WITH r AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS row_no FROM nation) " + " UNION ALL ".join(f"SELECT row_no AS \"row\", CAST({i} AS BIGINT) AS col, '{chr(64 + i)}' || row_no AS ref, '{k}' AS kind, CAST({c} AS VARCHAR) AS value FROM r WHERE {c} IS NOT NULL" for i, (c, k) in enumerate(zip(NATION, ("int", "string", "int"), strict=True), 1)),
    "range_scan": "WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) SELECT 'B' || n AS ref, CAST(o_custkey AS VARCHAR) AS value FROM r WHERE n BETWEEN 3 AND 12 UNION ALL SELECT 'C' || n, o_orderstatus FROM r WHERE n BETWEEN 3 AND 12",
    "typed_cells": "SELECT CAST(1 AS BIGINT) AS col, count(s_suppkey) AS n_numbers, CAST(0 AS BIGINT) AS n_texts, CAST(sum(s_suppkey) AS DOUBLE) AS total FROM supplier UNION ALL SELECT 2, 0, count(s_name), NULL FROM supplier UNION ALL SELECT 3, count(s_nationkey), 0, CAST(sum(s_nationkey) AS DOUBLE) FROM supplier UNION ALL SELECT 4, count(s_acctbal), 0, round(sum(s_acctbal), 2) FROM supplier",
    "a1_codec": f"SELECT p_partkey, {_LETTERS.format('p_partkey')} AS letters, CAST(p_partkey AS BIGINT) AS back FROM part WHERE p_partkey <= 18278",
    "table_by_header": 'SELECT row_number() OVER (ORDER BY s_suppkey) AS "row", s_suppkey, s_name, s_nationkey FROM supplier',
    "missing_address_repair": "SELECT p AS pos, p + 4 AS col, count(*) AS n FROM orders, (VALUES (1), (2), (3)) v(p) GROUP BY ALL",
    "number_formats": f"""WITH n AS (SELECT p_partkey, CAST(p_partkey * 7 % 4999 + 1 AS BIGINT) AS n, CAST(p_partkey * 11 % 19999 + 1 AS BIGINT) AS w FROM part),
      t AS (SELECT *, CASE WHEN w >= 1000 THEN ({_ONES})[w // 1000 + 1] || ' thousand' END AS th, CASE WHEN w % 1000 >= 100 THEN ({_ONES})[w % 1000 // 100 + 1] || ' hundred' END AS hu, w % 100 AS z FROM n)
      SELECT p_partkey, CAST(n AS VARCHAR) AS decimal, CASE WHEN n < 10 THEN '0' || n ELSE CAST(n AS VARCHAR) END AS decimalZero, {_ROMAN.format('n')} AS upperRoman,
      repeat(substr('abcdefghijklmnopqrstuvwxyz', CAST((n - 1) % 26 + 1 AS BIGINT), 1), (CASE WHEN n % 780 = 0 THEN 780 ELSE n % 780 END - 1) // 26 + 1) AS lowerLetter,
      n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
      printf('%04d', n) AS padded4, CASE WHEN n <= 20 THEN chr(CAST(9311 + n AS INTEGER)) ELSE CAST(n AS VARCHAR) END AS circle, '' AS bullet,
      (SELECT upper(x[1]) || x[2:] FROM (SELECT concat_ws(' ', th, hu, CASE WHEN z = 0 THEN NULL WHEN z < 20 THEN ({_ONES})[z + 1] WHEN z % 10 = 0 THEN ({_TENS})[z // 10 + 1] ELSE ({_TENS})[z // 10 + 1] || '-' || ({_ONES})[z % 10 + 1] END) AS x)) AS cardinalText,
      (SELECT upper(x[1]) || x[2:] FROM (SELECT concat_ws(' ', th, hu, CASE WHEN z = 0 THEN NULL WHEN z < 20 THEN ({_ORD})[z + 1] WHEN z % 10 = 0 THEN replace(({_TENS})[z // 10 + 1], 'ty', 'tieth') ELSE ({_TENS})[z // 10 + 1] || '-' || ({_ORD})[z % 10 + 1] END) || CASE WHEN z = 0 THEN 'th' ELSE '' END AS x)) AS ordinalText FROM t""",
    "ole_dates": "SELECT o_orderkey, round(date_diff('second', TIMESTAMP '1899-12-30', CAST(o_orderdate AS TIMESTAMP)) / 86400, 6) AS serial, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS six_hours_on FROM orders",
    "pivot_sum": "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_linestatus = 'F') AS DOUBLE) AS sum_f, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_linestatus = 'O') AS DOUBLE) AS sum_o FROM lineitem GROUP BY 1",
    "pivot_multi_value": "SELECT o_orderpriority, " + ", ".join(f"CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = '{s}') AS DOUBLE) AS sum_{s.lower()}, count(o_custkey) FILTER (o_orderstatus = '{s}') AS n_{s.lower()}" for s in "FOP") + " FROM orders GROUP BY 1",
    "pivot_cache_facts": " UNION ALL ".join(f"SELECT '{f}' AS field, min(x) AS least, max(x) AS most, bool_and(x = floor(x)) AS all_integer, count(*) AS n_items, sha256(string_agg(item, '|' ORDER BY first)) AS items_hash FROM (SELECT CAST({f} AS VARCHAR) AS item, min(o_orderkey) AS first, try_cast(CAST({f} AS VARCHAR) AS DOUBLE) AS x FROM orders GROUP BY {f})" for f in ("o_orderstatus", "o_orderpriority", "o_custkey")),
    "distinct_sorted_lists": "SELECT o_orderstatus, string_agg(p, ',' ORDER BY p) AS priorities FROM (SELECT DISTINCT o_orderstatus, o_orderpriority AS p FROM orders) GROUP BY 1",
    "document_metrics": f"WITH {BLOCKS} SELECT doc_id, count(*) AS n_paragraphs, count(*) FILTER (trim(text, ' ') = '') AS n_blank, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS average_length FROM blocks GROUP BY 1",
    "content_type_counts": f"WITH {BLOCKS} SELECT CASE WHEN trim(text, ' ') = '' THEN 'blank' WHEN regexp_matches(text, '^[A-Z][^.]*$') THEN 'title' WHEN regexp_matches(text, '[0-9]') THEN 'numeric' WHEN length(text) > 200 THEN 'long' ELSE 'body' END AS kind, count(*) AS n FROM blocks GROUP BY 1",
    "list_numbering_multilevel": f"""WITH t AS (SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_name) AS a FROM region), l AS (SELECT a, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS b FROM nation JOIN t ON n_regionkey = r_regionkey)
      SELECT r_name AS item, {_ROMAN.format('a')} || '.' AS label FROM t UNION ALL SELECT n_name, {_ROMAN.format('a')} || '.' || lower(chr(CAST(b + 64 AS INTEGER))) || ')' FROM l""",
    "page_number_sequence": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR) AS label FROM documents",
    "table_grid": """WITH l AS (SELECT l_orderkey AS tbl, row_number() OVER w AS r, l_returnflag AS f, lag(l_returnflag) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)),
      s AS (SELECT *, max(CASE WHEN p IS DISTINCT FROM f THEN r END) OVER (PARTITION BY tbl ORDER BY r) AS c FROM l) SELECT tbl, CAST(3 AS BIGINT) AS n_columns, count(*) FILTER (c < r) AS n_covered, max(r - c) AS deepest FROM s GROUP BY 1""",
    "nested_marker_depth": """WITH e AS (SELECT user_id, event_id, event_type, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)
      SELECT user_id, event_id, event_type, CAST(d + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS depth, event_type = 'error' AND d + 1 < 1 AS orphan FROM e WHERE event_type IN ('click', 'error')""",
    "ordered_row_numbers": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no FROM orders",
    "note_id_order": "WITH p AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'n' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS id, s_nationkey FROM supplier) SELECT id, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY try_cast(id AS INTEGER) NULLS LAST, id) AS nth FROM p",
}
ORACLES["unit_lengths"] = """WITH p AS (
  SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, ['pt', 'px', 'in', 'cm', 'mm', 'pc', 'em'][p_partkey % 7 + 1] AS unit FROM part
)
SELECT p_partkey, unit, round(CASE unit WHEN 'pt' THEN x * 20 WHEN 'px' THEN x * 15 WHEN 'in' THEN x * 1440 WHEN 'cm' THEN x * (1440 / 2.54::DOUBLE) WHEN 'mm' THEN x * (144 / 2.54::DOUBLE) WHEN 'pc' THEN x * 240 END, 4) AS twips,
  (p_partkey // 65536 % 256) || ',' || (p_partkey // 256 % 256) || ',' || (p_partkey % 256) AS rgb FROM p"""
_COLUMNS = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
            "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]}
ORACLES["column_metrics"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS n_distinct FROM {t}" for t, columns in _COLUMNS.items() for c in columns)
