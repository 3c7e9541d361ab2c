"""Queries on templates, cascades, exports, annotations and concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.functions import numbers as N
from quirelake.functions import text as T
from quirelake.operators import cascade, export, template, windows
from quirelake.plans.q_blocks import BLOCKS, WORDS
from quirelake.sources.tables import blocks, load


def _customers(spark, sf):
    """Customers with their orders nested, as template data."""
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    nested = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", F.round("o_totalprice").cast("long").alias("price")))).alias("orders"))
    return c.select("c_custkey", "c_name", "c_mktsegment").join(nested, "c_custkey", "left")


def template_repeat_conditional(spark, sf):
    """A line for each customer with orders, and for customers of one segment the words 'valued customer'."""
    c = _customers(spark, sf)
    n = F.coalesce(F.size("orders"), F.lit(0))
    body = F.concat(F.lit("Dear "), "c_name", F.when(template.condition(F.col("c_mktsegment"), match="BUILDING"), ", valued customer").otherwise(""), F.lit(": "), F.array_join(F.transform(F.coalesce("orders", F.array().cast("array<struct<o_orderkey:bigint,o_orderstatus:string,price:bigint>>")), lambda o: F.concat(F.lit("#"), o["o_orderkey"].cast("string"))), ", "))
    return c.where(n > 0).select("c_custkey", body.alias("text"))


def template_table_rows(spark, sf):
    c = _customers(spark, sf)
    total = F.aggregate(F.coalesce("orders", F.array().cast("array<struct<o_orderkey:bigint,o_orderstatus:string,price:bigint>>")), F.lit(0).cast("long"), lambda a, o: a + o["price"])
    t = template.table(c, ["c_custkey"], "orders", {"order": lambda i: i["o_orderkey"].cast("string"), "status": lambda i: i["o_orderstatus"], "price": lambda i: i["price"].cast("string")}, F.concat(F.lit("Total "), total.cast("string")))
    return t.select("c_custkey", F.col("line").cast("long").alias("line"), "text", "error")


def template_errors(spark, sf):
    """The status of a customer's order as a scalar: an error for none and for more than one."""
    c = _customers(spark, sf).withColumn("v", template.content(F.array_distinct(F.transform("orders", lambda o: o["o_orderstatus"])), path="Order/Status"))
    return c.select("c_custkey", "v.text", "v.error")


STYLES = [("Normal", None), ("Heading", "Normal"), ("Heading1", "Heading"), ("Heading2", "Heading1"), ("Quote", "Normal"), ("Strong", None), ("StrongQuote", "Quote")]
PROPERTIES = [("Normal", "font", "Serif"), ("Normal", "size", "11"), ("Heading", "bold", "true"), ("Heading", "font", "Sans"), ("Heading1", "size", "16"), ("Heading2", "bold", "true"), ("Heading2", "italic", "true"), ("Quote", "italic", "true"), ("StrongQuote", "italic", "true"), ("StrongQuote", "bold", "true"), ("Strong", "bold", "true")]


def _styles(spark):
    return spark.createDataFrame(STYLES, "style string, based_on string"), spark.createDataFrame(PROPERTIES, "style string, property string, value string")


def style_hierarchy(spark, sf):
    return cascade.style_chain(_styles(spark)[0])


def style_chain_cascade(spark, sf):
    s, p = _styles(spark)
    return cascade.effective(cascade.style_chain(s), p, ["bold", "italic"])


def effective_block_format(spark, sf):
    """The effective size and weight of document blocks whose style is chosen by their length."""
    b = blocks(load(spark, sf, "documents"))
    b = b.select("doc_id", "ord", F.when(F.length("text") < 20, "Heading1").when(F.length("text") < 40, "Heading2").when(F.length("text") > 400, "Quote").otherwise("Normal").alias("style"))
    e = style_chain_cascade(spark, sf)
    wide = e.groupBy("style").agg(F.max(F.when(F.col("property") == "size", F.col("value"))).alias("size"), F.max(F.when(F.col("property") == "bold", F.col("value"))).alias("bold"))
    return b.join(wide, "style", "left").groupBy("doc_id", "size", F.coalesce("bold", F.lit("false")).alias("bold")).agg(F.count("*").alias("n"))


CSS = "p{margin:1px 2px} .ad{margin:0;color:red} div.ad{color:blue} li{padding:1px 2px 3px} #top{color:green !important} nav{color:grey}"


def css_cascade_small(spark, sf):
    p = load(spark, sf, "pages")
    rules = cascade.css_rules(p.select("page_id", F.concat("html", F.lit(f"<style>{CSS}</style>")).alias("html")))
    e = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(?:p|li|nav|div)(?: [^>]*)?>"), F.lit(0))).alias("element", "t"))
    e = e.select("page_id", F.col("element").cast("long").alias("element"), F.regexp_extract("t", "^<([a-z]+)", 1).alias("tag"), F.regexp_extract("t", 'class="([^"]*)"', 1).alias("class"), F.regexp_extract("t", 'id="([^"]*)"', 1).alias("id"))
    w = cascade.cascade(e, rules).join(e.select("page_id", "element", "tag"), ["page_id", "element"])
    return w.groupBy("page_id", "tag", "property", "value").agg(F.count("*").alias("n"))


def list_counters(spark, sf):
    """Conversation turns as list items: users' turns are level 0, others level 1; the 5th turn restarts at 10."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", 0).otherwise(1).alias("level"), F.floor(F.col("turn") / 5).alias("num_id"), F.when(F.col("turn") % 5 == 4, 10).alias("override"), (F.col("turn") % 11 == 7).alias("deleted"))
    n = cascade.list_counters(c, ["conv_id"], "turn", [1, 1])
    label = cascade.level_text("%1.%2", F.col("counters"), [lambda x: N.list_number(x, "decimal"), lambda x: N.list_number(x, "lowerLetter")])
    return n.select("conv_id", "turn", F.array_join(F.col("counters").cast("array<string>"), ".").alias("counters"), label.alias("label"))


def page_estimate(spark, sf):
    """Sections of a document are its runs of blocks up to a blank block; pages are estimated for each and added up."""
    b = blocks(load(spark, sf, "documents")).select("doc_id", "ord", "text")
    s = windows.running(b, ["doc_id"], ["ord"], F.sum((F.trim("text") == "").cast("int")), "section")
    n = s.groupBy("doc_id", "section").agg(F.sum(F.length("text")).alias("n_chars"))
    return n.groupBy("doc_id").agg(F.sum(export.page_count(F.col("n_chars"))).cast("long").alias("pages"), F.count("*").alias("sections"))


def pawls_tokens(spark, sf):
    b = blocks(load(spark, sf, "documents")).select("doc_id", "ord", "text")
    t = export.token_layout(b, ["doc_id", "ord"])
    return t.groupBy("doc_id", "ord").agg(F.count("*").alias("n"), F.max("y").alias("last_y"), F.max("x").alias("right_x"))


def annotation_edges(spark, sf):
    return export.structural_edges(blocks(load(spark, sf, "documents")), "doc_id", F.length("text") < 40)


def _annotations(spark, sf):
    """The first 'the' of each document as an annotation of a label by its language; some are spoilt on purpose."""
    d = load(spark, sf, "documents").where("instr(text, ' the ') > 0")
    start = F.instr("text", " the ")
    k = F.col("doc_id") % 5
    return d.select("doc_id", F.concat(F.lit("ann-"), F.col("doc_id").cast("string")).alias("ann"), F.when(k == 1, "unknown").otherwise("article").alias("label"), start.alias("start"), F.when(k == 2, 10_000_000).otherwise(start + 3).alias("end"), F.when(k == 3, "thee").otherwise("the").alias("text"), F.when(k == 4, "0").otherwise(F.sha2("text", 256)).alias("doc_hash"))


def annotation_from_search(spark, sf):
    return _annotations(spark, sf).select("doc_id", "ann", "label", F.col("start").cast("long").alias("start"))


def annotation_validate(spark, sf):
    return export.validate(_annotations(spark, sf), load(spark, sf, "documents"), ["article"])


def annotation_project_html(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text").where("length(text) > 20")
    spans = d.select("doc_id", F.explode(F.array(F.struct(F.lit("a").alias("label"), F.lit(2).alias("start"), F.lit(9).alias("end")), F.struct(F.lit("b").alias("label"), F.lit(5).alias("start"), F.lit(15).alias("end")))).alias("s")).select("doc_id", "s.*")
    h = export.project(d, spans)
    return h.select("doc_id", F.sha2("html", 256).alias("html_hash"))


def page_citation_status(spark, sf):
    a = blocks(load(spark, sf, "documents")).select(F.concat(F.lit("p:body:"), "doc_id", F.lit("-"), "ord").alias("anchor"), "doc_id", "ord")
    m = a.where("ord > 0").select("anchor", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(2).alias("map_version"), F.when(F.col("doc_id") % 6 == 1, "x").otherwise("r1").alias("renderer"), F.explode(F.array(F.col("ord"), F.col("ord") + F.col("doc_id") % 2)).alias("page"))
    return export.cite(a.select("anchor"), m, 2, "r1")


def table_html(spark, sf):
    o = load(spark, sf, "orders")
    t = export.html_table(o, ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    return t.select("o_custkey", F.sha2("html", 256).alias("html_hash"))


def table_markdown(spark, sf):
    o = load(spark, sf, "orders").withColumn("note", F.when(F.col("o_custkey") % 9 == 0, F.repeat(F.lit("x"), 81)).otherwise(F.lit("a|b")))
    t = export.gfm_table(o, ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "note"])
    return t.select("o_custkey", "mode", F.sha2("markdown", 256).alias("markdown_hash"))


def document_concat_slices(spark, sf):
    """A new document from slices of others: blocks 1 to 3 of each document, then its first one, in document order
    for each source."""
    b = blocks(load(spark, sf, "documents")).join(load(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    parts = b.where("ord between 1 and 3").select("source", "doc_id", F.lit(0).alias("slice"), "ord", "hash").unionByName(b.where("ord = 0").select("source", "doc_id", F.lit(1).alias("slice"), "ord", "hash"))
    return parts.select("source", (F.row_number().over(W.partitionBy("source").orderBy("doc_id", "slice", "ord")) - 1).cast("long").alias("ord"), "hash")


def header_inheritance(spark, sf):
    """Every third turn of a conversation has a header of its own; others inherit it, by role."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("h"), F.col("turn").cast("string"))).alias("own"))
    return windows.preceding(c, ["conv_id", "role"], ["turn"], F.col("own"), "header").select("conv_id", "turn", "role", "header")


def interval_overlap_join(spark, sf):
    """Annotations and the blocks that they touch."""
    from quirelake.sources.tables import offsets

    b = offsets(blocks(load(spark, sf, "documents"))).select("doc_id", "ord", "start_offset", "end_offset")
    a = _annotations(spark, sf).select("doc_id", "ann", F.col("start").alias("s"), (F.col("start") + 60).alias("e"))
    return a.join(b, "doc_id").where("s < end_offset and e > start_offset").select("doc_id", "ann", "ord")


def field_codes(spark, sf):
    """Field instructions made of page links: type, argument and switches of each."""
    p = load(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("nth", "href"))
    code = F.concat(F.lit(' HYPERLINK "'), "href", F.lit('" \\l "x y" \\h '))
    tokens = F.regexp_extract_all(code, F.lit('"[^"]*"|[^ "]+'), F.lit(0))
    return p.withColumn("t", tokens).select("page_id", F.col("nth").cast("long").alias("nth"), F.upper(F.col("t")[0]).alias("kind"), F.regexp_replace(F.col("t")[1], '^"|"$', "").alias("argument"), F.array_join(F.filter("t", lambda x: F.startswith(x, F.lit("\\"))), " ").alias("switches"))


def field_instruction_depth(spark, sf):
    """Nested begin and end marks in token order: the outermost instruction's text."""
    e = load(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    e = windows.depth(e, ["user_id"], ["event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase")
    e = windows.preceding(e, ["user_id"], ["event_id"], F.when((F.col("event_type") == "click") & (F.col("depth") == 1), F.col("event_id")), "field")
    return e.where("field is not null and depth = 1").groupBy("user_id", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.substring(x["event_type"], 1, 1)), "").alias("text"))


def canonical_json_digest(spark, sf):
    """Orders as canonical JSON (sorted names, no spaces) and its digest."""
    o = load(spark, sf, "orders")
    j = F.to_json(F.struct("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"))
    return o.select("o_orderkey", j.alias("json"), F.sha2(j, 256).alias("digest"))


def compatibility_features(spark, sf):
    """Features of pages by a dimension of patterns, zero if absent."""
    dim = spark.createDataFrame([("table", "<table"), ("script", "<script"), ("bold", "<b>"), ("video", "<video")], "feature string, pattern string")
    p = load(spark, sf, "pages")
    n = [p.agg(F.sum(F.regexp_count("html", F.lit(x))).cast("long").alias("n")).select(F.lit(f).alias("feature"), "n") for f, x in (("table", "<table"), ("script", "<script"), ("bold", "<b>"), ("video", "<video"))]
    found = n[0].unionByName(n[1]).unionByName(n[2]).unionByName(n[3])
    return dim.join(found, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n"))


def edit_summary(spark, sf):
    b = blocks(load(spark, sf, "documents"))
    return b.groupBy("doc_id").agg(F.count("*").alias("anchors"), F.count_if(F.col("text").rlike("_{3,}")).alias("blank_runs"), F.count_if(F.trim("text") == "").alias("empty"), F.sum(F.size(T.words(F.col("text")))).cast("long").alias("words"))


QUERIES = {f.__name__: f for f in (template_repeat_conditional, template_table_rows, template_errors, style_hierarchy, style_chain_cascade, effective_block_format, css_cascade_small, list_counters, page_estimate, pawls_tokens, annotation_edges, annotation_from_search, annotation_validate, annotation_project_html, page_citation_status, table_html, table_markdown, document_concat_slices, header_inheritance, interval_overlap_join, field_codes, field_instruction_depth, canonical_json_digest, compatibility_features, edit_summary)}

_SV = ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in STYLES)
_PV = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in PROPERTIES)
_CHAIN = f"""s(style, based_on) AS (VALUES {_SV}), chain AS (SELECT style, style AS ancestor, CAST(0 AS BIGINT) AS depth FROM s UNION ALL SELECT c.style, s.based_on, c.depth + 1 FROM chain c JOIN s ON s.style = c.ancestor WHERE s.based_on IS NOT NULL)"""
_EFF = f"""WITH RECURSIVE {_CHAIN}, p(style, property, value) AS (VALUES {_PV}), e AS (SELECT chain.style, property, CASE WHEN property IN ('bold', 'italic') THEN CASE WHEN count(*) FILTER (value = 'true') % 2 = 1 THEN 'true' ELSE 'false' END ELSE arg_min(value, depth) END AS value FROM chain JOIN p ON p.style = chain.ancestor GROUP BY chain.style, property)"""
_ANN = """a AS (SELECT doc_id, 'ann-' || doc_id AS ann, CASE WHEN doc_id % 5 = 1 THEN 'unknown' ELSE 'article' END AS label, instr(text, ' the ') AS start, doc_id % 5 AS k, text FROM documents WHERE instr(text, ' the ') > 0)"""
ORACLES = {
    "template_repeat_conditional": "SELECT c_custkey, 'Dear ' || c_name || CASE WHEN c_mktsegment = 'BUILDING' THEN ', valued customer' ELSE '' END || ': ' || string_agg('#' || o_orderkey, ', ' ORDER BY o_orderkey) AS text FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment",
    "template_table_rows": """WITH o AS (SELECT o_custkey AS c_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, o_orderkey || ' | ' || o_orderstatus || ' | ' || CAST(round(o_totalprice) AS BIGINT) AS text FROM orders)
      SELECT c_custkey, line, text, CAST(NULL AS VARCHAR) AS error FROM o JOIN customer USING (c_custkey) UNION ALL SELECT c_custkey, 1, '', 'orders: nothing selected' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
      UNION ALL SELECT c_custkey, greatest(count(o_orderkey), 1) + 1, 'Total ' || coalesce(sum(CAST(round(o_totalprice) AS BIGINT)), 0), NULL FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "template_errors": """SELECT c_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE '' END AS text, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'Order/Status: more than one node' WHEN count(DISTINCT o_orderstatus) < 1 THEN 'Order/Status: nothing selected' END AS error
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "style_hierarchy": f"WITH RECURSIVE {_CHAIN} SELECT * FROM chain",
    "style_chain_cascade": _EFF + " SELECT * FROM e",
    "effective_block_format": _EFF + ", " + BLOCKS + """, b AS (SELECT doc_id, CASE WHEN length(text) < 20 THEN 'Heading1' WHEN length(text) < 40 THEN 'Heading2' WHEN length(text) > 400 THEN 'Quote' ELSE 'Normal' END AS style FROM blocks),
      w AS (SELECT style, max(value) FILTER (property = 'size') AS size, max(value) FILTER (property = 'bold') AS bold FROM e GROUP BY 1) SELECT doc_id, size, coalesce(bold, 'false') AS bold, count(*) AS n FROM b LEFT JOIN w USING (style) GROUP BY ALL""",
    "page_estimate": f"""WITH {BLOCKS}, s AS (SELECT doc_id, text, sum(CASE WHEN trim(text, ' ') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS section FROM blocks), n AS (SELECT doc_id, section, sum(length(text)) AS c FROM s GROUP BY ALL)
      SELECT doc_id, CAST(sum(greatest(1, ceil(c / 2500))) AS BIGINT) AS pages, count(*) AS sections FROM n GROUP BY 1""",
    "annotation_edges": f"""WITH {BLOCKS}, s AS (SELECT doc_id, ord, length(text) < 40 AS h, sum(CASE WHEN length(text) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS s FROM blocks), k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i FROM s WHERE s > 0 AND NOT h)
      SELECT doc_id, 'rel-' || i AS edge, 'section-' || CAST(s - 1 AS BIGINT) AS parent, 'para-' || i AS child FROM k""",
    "annotation_from_search": f"WITH {_ANN} SELECT doc_id, ann, label, CAST(start AS BIGINT) AS start FROM a",
    "annotation_validate": f"WITH {_ANN} SELECT doc_id, ann, CASE k WHEN 4 THEN 'HashMismatch' WHEN 1 THEN 'MissingLabel' WHEN 2 THEN 'OutOfBounds' WHEN 3 THEN 'TextMismatch' END AS issue FROM a",
    "annotation_project_html": """WITH e AS (SELECT doc_id, text, list_transform([0, 2, 5, 9, 15], lambda c, i: [c, ([2, 5, 9, 15, CAST(length(text) AS INTEGER)])[i]]) AS p FROM documents WHERE length(text) > 20),
      x AS (SELECT doc_id, list_transform(p, lambda c: replace(replace(substr(text, c[1] + 1, c[2] - c[1]), '&', '&amp;'), '<', '&lt;')) AS t FROM e)
      SELECT doc_id, sha256(t[1] || '<span class="a">' || t[2] || '</span><span class="a b">' || t[3] || '</span><span class="b">' || t[4] || '</span>' || t[5]) AS html_hash FROM x""",
    "page_citation_status": f"""WITH {BLOCKS}, a AS (SELECT 'p:body:' || doc_id || '-' || ord AS anchor, doc_id, ord FROM blocks), s AS (SELECT *, CASE WHEN ord = 0 THEN 'noPageMap' WHEN doc_id % 4 = 0 THEN 'staleVersion' WHEN doc_id % 6 = 1 THEN 'otherRenderer' ELSE 'available' END AS status FROM a)
      SELECT anchor, status, CASE WHEN status = 'available' THEN ord END AS first_page, CASE WHEN status = 'available' THEN ord + doc_id % 2 END AS last_page FROM s""",
    "table_html": "SELECT o_custkey, sha256('<table>' || string_agg('<tr><td>' || o_orderkey || '</td><td>' || o_orderstatus || '</td><td>' || o_orderpriority || '</td></tr>', '' ORDER BY o_orderkey) || '</table>') AS html_hash FROM orders GROUP BY 1",
    "table_markdown": r"""SELECT o_custkey, CASE WHEN o_custkey % 9 = 0 THEN 'opaque' ELSE 'gfm' END AS mode, sha256(CASE WHEN o_custkey % 9 = 0 THEN '[table]' ELSE '| o_orderkey | o_orderstatus | note |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' | a\|b |', chr(10) ORDER BY o_orderkey) END) AS markdown_hash FROM orders GROUP BY o_custkey""",
    "document_concat_slices": f"""WITH {BLOCKS}, p AS (SELECT source, b.doc_id, CASE WHEN ord = 0 THEN 1 ELSE 0 END AS sl, ord, hash FROM blocks b JOIN documents d ON d.doc_id = b.doc_id WHERE ord BETWEEN 0 AND 3) SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, sl, ord) - 1 AS ord, hash FROM p""",
    "header_inheritance": "SELECT conv_id, turn, role, 'h' || max(CASE WHEN turn % 3 = 0 THEN turn END) OVER (PARTITION BY conv_id, role ORDER BY turn) AS header FROM conversations",
    "interval_overlap_join": f"""WITH {BLOCKS}, {_ANN}, o AS (SELECT doc_id, ord, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS e, length(text) AS n FROM blocks) SELECT a.doc_id, ann, ord FROM a JOIN o ON o.doc_id = a.doc_id AND a.start < o.e AND a.start + 60 > o.e - o.n""",
    "field_codes": r"""SELECT page_id, i - 1 AS nth, 'HYPERLINK' AS kind, h[i] AS argument, '\l \h' AS switches FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages), LATERAL unnest(range(1, len(h) + 1)) AS u(i)""",
    "field_instruction_depth": """WITH e AS (SELECT *, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS depth FROM events),
      f AS (SELECT *, max(CASE WHEN event_type = 'click' AND depth = 1 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS field FROM e)
      SELECT user_id, field, string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) AS text FROM f WHERE field IS NOT NULL AND depth = 1 GROUP BY ALL""",
    "canonical_json_digest": """WITH j AS (SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' AS json FROM orders) SELECT *, sha256(json) AS digest FROM j""",
    "compatibility_features": " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST(sum(len(regexp_extract_all(html, '{x}'))) AS BIGINT) AS n FROM pages" for f, x in (("table", "<table"), ("script", "<script"), ("bold", "<b>"), ("video", "<video"))),
}
ORACLES["edit_summary"] = f"""WITH {BLOCKS}
SELECT doc_id, count(*) AS anchors, count(*) FILTER (regexp_matches(text, '_{{3,}}')) AS blank_runs, count(*) FILTER (trim(text, ' ') = '') AS empty, CAST(sum(len({WORDS.format('text')})) AS BIGINT) AS words FROM blocks GROUP BY doc_id"""
