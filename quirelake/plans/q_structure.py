"""Queries on scopes, trees, inline runs, versions with formats, findings and revision registries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.functions import text as T
from quirelake.operators import structure as S
from quirelake.plans.q_blocks import BLOCKS, REVISED, WORDS
from quirelake.sources.tables import blocks, load, revised


def _blocks(spark, sf):
    return blocks(load(spark, sf, "documents"))


def _tree(spark, sf):
    """Customers, their orders and the lines of these as nodes: doc, path, names, ord, type, text."""
    c, o, l = load(spark, sf, "customer"), load(spark, sf, "orders"), load(spark, sf, "lineitem")
    key, order = F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string")
    node = lambda df, path, names, ord_, text: df.select(F.col("c_custkey").alias("doc"), path.alias("path"), F.array(*[F.lit(x) for x in names]).alias("names"), ord_.cast("long").alias("ord"), F.lit(names[-1]).alias("type"), text.alias("text"))
    co = o.withColumn("c_custkey", F.col("o_custkey"))
    col = co.join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return node(c, key, ["customer"], F.lit(0), F.col("c_name")).unionByName(
        node(co, F.concat_ws("/", key, order), ["customer", "order"], F.col("o_orderkey"), F.col("o_orderpriority"))).unionByName(
        node(col, F.concat_ws("/", key, order, F.col("l_linenumber").cast("string")), ["customer", "order", "line"], F.col("l_linenumber"), F.col("l_returnflag")))


def scope_filter(spark, sf):
    """First blocks as headers, last ones as footers, the rest as body; headers and footers are asked for."""
    b = _blocks(spark, sf).withColumn("last", F.max("ord").over(W.partitionBy("doc_id")))
    b = b.withColumn("scope", F.when(F.col("ord") == 0, "headers").when(F.col("ord") == F.col("last"), "footers").otherwise("body"))
    return S.scoped(b, S.SCOPES["headers"] | S.SCOPES["footers"]).select("doc_id", "ord", "scope", "hash")


def has_revisions(spark, sf):
    """Documents with a block that their revision hasn't."""
    b = _blocks(spark, sf)
    r = revised(b).select("doc_id", "hash").distinct().withColumn("there", F.lit(True))
    return S.having(b.join(r, ["doc_id", "hash"], "left"), F.col("there").isNull(), "has_revisions")


def nodes_by_type(spark, sf):
    return S.nodes_of_type(_tree(spark, sf), "order", "line").select("doc", "path", "type")


def nodes_by_text(spark, sf):
    return S.nodes_with_text(_tree(spark, sf), "URGENT").select("doc", "path", "text")


def table_column_cells(spark, sf):
    """Line items as a table for each order, return flag and line status as its columns."""
    l = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("row"), F.posexplode(F.array("l_returnflag", "l_linestatus")).alias("col", "v"))
    cells = l.select("l_orderkey", "row", F.col("col").cast("long").alias("col"), F.concat_ws(":", F.col("row").cast("string"), F.col("col").cast("string"), "v").alias("id"))
    return S.column_cells(cells, ["l_orderkey"]).select("l_orderkey", "col", F.array_join("ids", " ").alias("ids"))


def trimmed_descendants(spark, sf):
    return S.descendants_trimmed(_tree(spark, sf), "customer", "order").select("doc", "path")


def siblings_reversed(spark, sf):
    """The line numbers of each order, a repeated one once."""
    l = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line")).distinct()
    return S.before_reversed(l, ["l_orderkey"], "line", "line").select("l_orderkey", "line", F.array_join(F.col("before").cast("array<string>"), ",").alias("before"))


def xpath_selection(spark, sf):
    """The key of a customer's one urgent order, from XML."""
    o = load(spark, sf, "orders")
    part = F.concat(F.lit('<o p="'), "o_orderpriority", F.lit('"><k>'), F.col("o_orderkey").cast("string"), F.lit("</k></o>"))
    x = o.groupBy("o_custkey").agg(F.concat(F.lit("<c>"), F.array_join(F.array_sort(F.collect_list(part)), ""), F.lit("</c>")).alias("xml"))
    v = S.xpath_single("xml", '/c/o[@p="1-URGENT"]/k')
    return x.select("o_custkey", v["value"].alias("value"), v["error"].alias("error"))


def simplified_runs(spark, sf):
    """Words as inlines: each fourth is a bookmark, each third bold, each fifth a tab."""
    w = _blocks(spark, sf).select("doc_id", F.col("ord").alias("block"), F.posexplode(T.words(F.col("text"))).alias("ord", "text"))
    w = w.withColumn("kind", F.when(F.col("ord") % 4 == 3, "bookmark").when(F.col("ord") % 5 == 4, "tab").otherwise("run")).withColumn("format", F.when(F.col("ord") % 3 == 2, "b").otherwise(""))
    return S.simplify(w, ["doc_id", "block"], drop=("bookmark",)).select("doc_id", "block", "run", "format", "text")


def interrupted_words(spark, sf):
    """The second word of each block is cut in two by a note reference of no width."""
    b = _blocks(spark, sf).where("text rlike '^[^ ]+ [^ ]{2,} '")
    w = F.split("text", " ")
    token = lambda o, kind, key, start, end: F.struct(F.lit(o).cast("long").alias("ord"), F.lit(kind).alias("kind"), key.alias("key"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    a, n, m = F.length(w[0]), F.length(w[1]), F.length(w[0]) + 2
    tokens = b.select("doc_id", F.col("ord").alias("block"), F.explode(F.array(
        token(0, "word", w[0], F.lit(0), a), token(1, "separator", F.lit(" "), a, a + 1), token(2, "word", F.substr(w[1], F.lit(1), F.lit(1)), a + 1, m),
        token(3, "atom", F.lit("^"), m, m), token(4, "word", F.substr(w[1], F.lit(2), n), m, a + 1 + n))).alias("t")).select("doc_id", "block", "t.*")
    return S.interrupted(tokens, ["doc_id", "block"]).select("doc_id", "block", "ord", "match_key")


def _formatted(spark, sf):
    """Blocks, and their revision in which each third document has another format in each second block."""
    b = _blocks(spark, sf)
    left = b.select("doc_id", "ord", "text", F.lit("plain").alias("format"))
    right = revised(b).select("doc_id", "ord", "text", F.when((F.col("doc_id") % 3 == 0) & (F.col("ord") % 2 == 0), "bold").otherwise("plain").alias("format"))
    return left, right


def format_aware_pairs(spark, sf):
    return S.format_aware_pairs(*_formatted(spark, sf))


def unexplained_relocations(spark, sf):
    """Parts move with their block; the moves of every seventh document go one block too far."""
    p = S.format_aware_pairs(*_formatted(spark, sf)).select("doc_id", F.col("left_ord").alias("left_anchor"), F.col("right_ord").alias("right_anchor"))
    moves = p.select("doc_id", F.col("left_anchor").alias("before"), (F.col("right_anchor") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).cast("long").alias("after"))
    return S.relocations(moves, p)


def insert_id_merge(spark, sf):
    """The second block of each document is replaced by the text of the benchmark item of its number, word by word."""
    b = _blocks(spark, sf)
    items = load(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("insert_id"), F.posexplode(F.split("text", " ")).alias("at", "text"))
    marks = b.where("ord = 1").select("doc_id", "ord", F.col("doc_id").cast("string").alias("insert_id"))
    return S.merged_slices(b.select("doc_id", "ord", "text"), items.withColumn("at", F.col("at").cast("long")), marks).select("doc_id", "ord", F.sha2("text", 256).alias("hash"))


def session_diff(spark, sf):
    b = _blocks(spark, sf)
    return S.session_diff(b.select("doc_id", F.col("ord").alias("anchor"), "text"), revised(b).select("doc_id", F.col("ord").alias("anchor"), "text"))


def note_alignment(spark, sf):
    """Blocks as notes. Without SQL: a longest common subsequence, then greedy."""
    b = _blocks(spark, sf).select("doc_id", "ord", "text")
    return S.note_pairs(b, revised(b))


def aligned_table_rows(spark, sf):
    """Line items of an order against a version in which each third row is gone and quantities of others change."""
    l = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("row"), F.col("l_partkey").cast("string").alias("a"), F.col("l_returnflag").alias("b"), F.col("l_quantity").cast("long").alias("c"))
    left = l.select("doc_id", "row", F.array("a", "b", F.col("c").cast("string")).alias("cells"))
    right = l.where("row % 3 <> 0").select("doc_id", "row", F.array("a", "b", (F.col("c") + F.col("row") % 2).cast("string")).alias("cells"))
    return S.aligned_rows(left, right, "doc_id")


def _findings(spark, sf):
    e = load(spark, sf, "events")
    return e.select("user_id", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warning").when(F.col("event_type") == "view", "note").otherwise("info").alias("severity"), F.col("event_type").alias("code"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("part"), (F.col("event_id") % 3).cast("string"))).alias("part"), F.floor(F.col("event_id") / 4).alias("location"), F.col("event_id").alias("finding_id"))


def finding_order(spark, sf):
    return S.finding_order(_findings(spark, sf), ["user_id"]).select("user_id", "finding_id", "severity", "place")


def comparison_log(spark, sf):
    return S.log_summary(_findings(spark, sf), ["user_id"], "severity")


def fill_order(spark, sf):
    l = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("anchor"), F.col("l_linenumber").cast("long").alias("start"))
    return S.fill_order(l, ["l_orderkey"])


def _registry(spark, sf):
    """Line items as revisions: some without an id, with a wrong one, with the one before, or of another family."""
    l = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("ord"), "l_returnflag", "l_partkey")
    n, p = F.col("ord"), F.col("l_partkey")
    rid = F.when(p % 11 == 0, F.lit(None)).when(p % 13 == 0, "x1").when(p % 7 == 0, (n - 1).cast("string")).otherwise(n.cast("string"))
    return S.registry(l.select("doc_id", "ord", rid.alias("revision_id"), F.when(F.col("l_returnflag") == "A", "ins").when(F.col("l_returnflag") == "R", "del").otherwise("customXmlMove").alias("family")))


def revision_registry(spark, sf):
    return _registry(spark, sf)


def selective_resolution(spark, sf):
    """The revisions 1, 2 and 9 of each order: the first and the last are accepted."""
    d = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("9"))).alias("revision_id")).withColumn("accept", F.col("revision_id") != "2")
    return S.resolve(_registry(spark, sf), d)


def bulk_resolution(spark, sf):
    return S.bulk_allowed(_registry(spark, sf))


def format_edits(spark, sf):
    """Blocks with a font; each second one becomes bold, each third loses the font."""
    b = _blocks(spark, sf).select("doc_id", "ord", F.create_map(F.lit("font"), F.lit("Serif")).alias("format"))
    bold = F.when(F.col("ord") % 2 == 0, F.create_map(F.lit("bold"), F.lit("true"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    font = F.when(F.col("ord") % 3 == 0, F.expr("map('font', cast(null as string))")).otherwise(F.expr("cast(map() as map<string,string>)"))
    out = S.format_applied(b, b.where("ord % 2 = 0 or ord % 3 = 0").select("doc_id", "ord", F.map_concat(bold, font).alias("format")))
    return out.select("doc_id", "ord", F.col("format")["bold"].alias("bold"), F.col("format")["font"].alias("font"))


def notes_renumbered(spark, sf):
    """A note on each line of an order, and a new one before every second."""
    n = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("ord"), F.lit(5).cast("long").alias("at"), F.col("l_returnflag").alias("text"))
    return S.notes_inserted(n, n.where("ord % 2 = 0").select("doc_id", "ord", F.lit(2).cast("long").alias("at"), F.lit("new").alias("text")))


QUERIES = {f.__name__: f for f in (scope_filter, has_revisions, nodes_by_type, nodes_by_text, table_column_cells, trimmed_descendants, siblings_reversed, xpath_selection, simplified_runs, interrupted_words,
                                   format_aware_pairs, unexplained_relocations, insert_id_merge, session_diff, note_alignment, aligned_table_rows, finding_order, comparison_log, fill_order, revision_registry,
                                   selective_resolution, bulk_resolution, format_edits, notes_renumbered)}

FORMATTED = REVISED + """, l AS (SELECT doc_id, ord, text, 'plain' AS format FROM blocks), r AS (SELECT doc_id, ord, text, CASE WHEN doc_id % 3 = 0 AND ord % 2 = 0 THEN 'bold' ELSE 'plain' END AS format FROM rev),
  p1 AS (SELECT x.doc_id, x.o AS left_ord, y.o AS right_ord FROM (SELECT doc_id, text, format, min(ord) AS o FROM l GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT doc_id, text, format, min(ord) AS o FROM r GROUP BY ALL HAVING count(*) = 1) y USING (doc_id, text, format)),
  l2 AS (SELECT doc_id, text, min(ord) AS o, min(format) AS f FROM l WHERE (doc_id, ord) NOT IN (SELECT (doc_id, left_ord) FROM p1) GROUP BY ALL HAVING count(*) = 1),
  r2 AS (SELECT doc_id, text, min(ord) AS o, min(format) AS f FROM r WHERE (doc_id, ord) NOT IN (SELECT (doc_id, right_ord) FROM p1) GROUP BY ALL HAVING count(*) = 1),
  fp AS (SELECT doc_id, left_ord, right_ord, 'Equal' AS kind FROM p1 UNION ALL SELECT l2.doc_id, l2.o, r2.o, CASE WHEN l2.f = r2.f THEN 'Equal' ELSE 'FormatOnly' END FROM l2 JOIN r2 USING (doc_id, text) WHERE l2.f = r2.f OR len(""" + WORDS.format("l2.text") + """) > 0)"""
FINDINGS = "f AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'view' THEN 'note' ELSE 'info' END AS severity, event_type AS code, event_id AS location FROM events)"
REGISTRY = """g AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS ord, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 'x1' WHEN l_partkey % 7 = 0 THEN CAST(l_linenumber - 1 AS VARCHAR) ELSE CAST(l_linenumber AS VARCHAR) END AS revision_id,
    CASE l_returnflag WHEN 'A' THEN 'ins' WHEN 'R' THEN 'del' ELSE 'customXmlMove' END AS family FROM lineitem),
  reg AS (SELECT g.*, CASE WHEN revision_id IS NULL OR NOT regexp_full_match(revision_id, '[0-9]+') THEN 'malformed' WHEN count(*) OVER (PARTITION BY doc_id, revision_id) > 1 THEN 'ambiguous' WHEN family NOT IN ('ins', 'del') THEN 'unsupported' ELSE 'supported' END AS status FROM g)"""

ORACLES = {
    "scope_filter": f"WITH {BLOCKS} SELECT doc_id, ord, CASE WHEN ord = 0 THEN 'headers' ELSE 'footers' END AS scope, hash FROM blocks WHERE ord = 0 OR ord = n - 1",
    "has_revisions": f"WITH {REVISED} SELECT doc_id, bool_or((doc_id, hash) NOT IN (SELECT (doc_id, hash) FROM rev)) AS has_revisions FROM blocks GROUP BY 1",
    "nodes_by_type": "SELECT o_custkey AS doc, o_custkey || '/' || o_orderkey AS path, 'order' AS type FROM orders UNION ALL SELECT o_custkey, o_custkey || '/' || o_orderkey || '/' || l_linenumber, 'line' FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "nodes_by_text": "SELECT o_custkey AS doc, o_custkey || '/' || o_orderkey AS path, o_orderpriority AS text FROM orders WHERE o_orderpriority ILIKE '%urgent%' UNION ALL SELECT c_custkey, CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE c_name ILIKE '%urgent%'",
    "table_column_cells": "SELECT l_orderkey, c AS col, string_agg(l_linenumber || ':' || c || ':' || CASE c WHEN 0 THEN l_returnflag ELSE l_linestatus END, ' ' ORDER BY l_linenumber, CASE c WHEN 0 THEN l_returnflag ELSE l_linestatus END) AS ids FROM lineitem, range(2) AS t(c) GROUP BY ALL",
    "trimmed_descendants": "SELECT o_custkey AS doc, o_custkey || '/' || o_orderkey AS path FROM orders",
    "siblings_reversed": "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT a.l_orderkey, CAST(a.l_linenumber AS BIGINT) AS line, coalesce(string_agg(CAST(b.l_linenumber AS VARCHAR), ',' ORDER BY b.l_linenumber DESC), '') AS before FROM d a LEFT JOIN d b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber GROUP BY ALL",
    "xpath_selection": "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') = 1 THEN CAST(max(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS VARCHAR) END AS value, CASE count(*) FILTER (o_orderpriority = '1-URGENT') WHEN 0 THEN 'none' WHEN 1 THEN NULL ELSE 'several' END AS error FROM orders GROUP BY 1",
    "simplified_runs": f"""WITH {BLOCKS}, w AS (SELECT doc_id, ord AS block, {WORDS.format('text')} AS ws FROM blocks), x AS (SELECT doc_id, block, i - 1 AS i, ws[i] AS t FROM w, LATERAL unnest(range(1, len(ws) + 1)) AS u(i)),
      k AS (SELECT doc_id, block, i, CASE WHEN i % 5 = 4 THEN ' ' ELSE t END AS t, CASE WHEN i % 3 = 2 THEN 'b' ELSE '' END AS format FROM x WHERE i % 4 <> 3),
      g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY i) - row_number() OVER (PARTITION BY doc_id, block, format ORDER BY i) AS island FROM k),
      m AS (SELECT doc_id, block, format, island, min(i) AS i, string_agg(t, '' ORDER BY i) AS text FROM g GROUP BY ALL)
      SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY i) - 1 AS run, format, text FROM m""",
    "interrupted_words": f"""WITH {BLOCKS}, w AS (SELECT doc_id, ord AS block, string_split(text, ' ') AS s FROM blocks WHERE regexp_matches(text, '^[^ ]+ [^ ]{{2,}} '))
      SELECT doc_id, block, CAST(i AS BIGINT) AS ord, CASE i WHEN 0 THEN s[1] WHEN 1 THEN ' ' WHEN 2 THEN left(s[2], 1) || chr(1) || 'iw:^' WHEN 3 THEN '^' ELSE substr(s[2], 2) || chr(1) || 'iw:^' END AS match_key FROM w, range(5) AS t(i)""",
    "format_aware_pairs": f"WITH {FORMATTED} SELECT doc_id, left_ord, right_ord, kind FROM fp",
    "unexplained_relocations": f"WITH {FORMATTED} SELECT doc_id, left_ord AS before, right_ord + 1 AS after FROM fp WHERE doc_id % 7 = 0 AND left_ord <> right_ord + 1",
    "insert_id_merge": f"""WITH {BLOCKS}, s AS (SELECT CAST(item_id AS VARCHAR) AS id, i, string_split(text, ' ')[i] AS t FROM benchmark, LATERAL unnest(range(1, len(string_split(text, ' ')) + 1)) AS u(i)),
      m AS (SELECT doc_id, ord, 0 AS i, text FROM blocks WHERE ord <> 1 UNION ALL SELECT doc_id, ord, i, t FROM blocks JOIN s ON id = CAST(doc_id AS VARCHAR) WHERE ord = 1)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, i) - 1 AS ord, sha256(text) AS hash FROM m""",
    "session_diff": f"""WITH {REVISED}, j AS (SELECT coalesce(b.doc_id, v.doc_id) AS doc_id, coalesce(b.ord, v.ord) AS anchor, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN v.doc_id IS NULL THEN 'removed' WHEN b.text <> v.text THEN 'modified' END AS change
      FROM blocks b FULL JOIN rev v ON b.doc_id = v.doc_id AND b.ord = v.ord) SELECT * FROM j WHERE change IS NOT NULL""",
    "finding_order": f"WITH {FINDINGS} SELECT user_id, location AS finding_id, severity, row_number() OVER (PARTITION BY user_id ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 ELSE 4 END, code, CASE location % 3 WHEN 0 THEN '' ELSE 'part' || location % 3 END, location // 4, location) - 1 AS place FROM f",
    "comparison_log": f"WITH {FINDINGS} SELECT user_id, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info, bool_or(severity = 'warning') AS has_warnings, bool_or(severity = 'error') AS has_errors FROM f GROUP BY 1",
    "fill_order": "SELECT l_orderkey, l_returnflag AS anchor, CAST(l_linenumber AS BIGINT) AS start, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag DESC, l_linenumber DESC) - 1 AS turn FROM lineitem",
    "revision_registry": f"WITH {REGISTRY} SELECT doc_id, ord, revision_id, family, status FROM reg",
    "selective_resolution": f"""WITH {REGISTRY}, s AS (SELECT doc_id, revision_id, min(status) AS status, min(family) AS family FROM reg GROUP BY ALL), d AS (SELECT o_orderkey AS doc_id, v AS revision_id, v <> '2' AS accept FROM orders, (VALUES ('1'), ('2'), ('9')) AS t(v))
      SELECT d.doc_id, d.revision_id, d.accept, CASE WHEN status IS NULL THEN 'notFound' WHEN status <> 'supported' THEN status WHEN (family = 'ins') = accept THEN 'kept' ELSE 'removed' END AS outcome FROM d LEFT JOIN s ON d.doc_id = s.doc_id AND d.revision_id = s.revision_id""",
    "bulk_resolution": f"WITH {REGISTRY} SELECT doc_id, bool_and(status = 'supported') AS allowed FROM reg GROUP BY 1",
    "format_edits": f"WITH {BLOCKS} SELECT doc_id, ord, CASE WHEN ord % 2 = 0 THEN 'true' END AS bold, CASE WHEN ord % 3 <> 0 THEN 'Serif' END AS font FROM blocks",
    "notes_renumbered": """WITH n AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS ord, 5::BIGINT AS "at", l_returnflag AS text FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, 'new' FROM lineitem WHERE l_linenumber % 2 = 0)
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, "at", text) AS number FROM n""",
}
