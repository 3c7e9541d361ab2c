"""Queries that search documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.functions import text as T
from quirelake.operators import search, windows
from quirelake.plans.q_blocks import BLOCKS
from quirelake.sources.tables import blocks, html_text, load


def _blocks(spark, sf):
    return blocks(load(spark, sf, "documents"))


def _templated(spark, sf):
    """Documents with placeholders: the second word of each block is put in brackets, every fifth block gets a blank."""
    b = _blocks(spark, sf).where("length(text) > 0")
    t = F.regexp_replace("text", "^([^ ]+) ([^ ]+)", "$1 [$2]")
    return b.withColumn("text", F.when(F.col("ord") % 5 == 0, F.concat(t, F.lit(" $[____] and [*insert date] or [this / that]"))).otherwise(t)).select("doc_id", "ord", "text")


TEMPLATED = BLOCKS + r""", tpl AS (SELECT doc_id, ord, CASE WHEN ord % 5 = 0 THEN t || ' $[____] and [*insert date] or [this / that]' ELSE t END AS text
  FROM (SELECT doc_id, ord, regexp_replace(text, '^([^ ]+) ([^ ]+)', '\1 [\2]') AS t FROM blocks WHERE length(text) > 0))"""


def find_all_by_text(spark, sf):
    return search.find_text(_blocks(spark, sf), "THE THE", ignore_case=True).select("doc_id", "ord", "hash")


def find_first_by_text(spark, sf):
    return search.first_per(search.find_text(_blocks(spark, sf), "que")).select("doc_id", "ord", "hash")


def find_by_regex(spark, sf):
    return _blocks(spark, sf).where(F.col("text").rlike("[0-9]{4,}")).select("doc_id", "ord", F.regexp_count("text", F.lit("[0-9]{4,}")).cast("long").alias("n"))


def find_by_kind(spark, sf):
    b = _blocks(spark, sf).withColumn("kind", F.when(F.trim("text") == "", "blank").when(F.length("text") < 40, "heading").when(F.col("text").rlike("^[-*|]|\\|"), "table").otherwise("paragraph"))
    return b.where(F.col("kind").isin("heading", "table")).select("doc_id", "ord", "kind")


def block_info_lookup(spark, sf):
    """Information for requested anchors, null for those that don't exist: block 0, 5 and 50 of every document."""
    want = load(spark, sf, "documents").select("doc_id", F.explode(F.array(*(F.lit(i).cast("long") for i in (0, 5, 50)))).alias("ord"))
    return want.join(_blocks(spark, sf), ["doc_id", "ord"], "left").select("doc_id", "ord", F.col("hash").isNotNull().alias("found"), F.length("text").cast("long").alias("n_chars"))


def find_by_label(spark, sf):
    """Blocks of documents labelled toxic (a semi-join on the label)."""
    lab = load(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return _blocks(spark, sf).join(lab, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_blocks"))


def text_occurrences_overlapping(spark, sf):
    needles = load(spark, sf, "benchmark").select("item_id", F.regexp_extract("text", "^([^ ]+ [^ ]+)", 1).alias("text"))
    return search.occurrences(load(spark, sf, "documents").select("doc_id", "text"), needles)


def grep_context_sentence(spark, sf):
    g = search.grep_first(_blocks(spark, sf), "[A-Z][a-z]+tion", "sentence", 60)
    return g.select("doc_id", "ord", "match", F.col("start").cast("long").alias("start"), "before", "after")


def grep_context_modes(spark, sf):
    g = [search.grep_first(_blocks(spark, sf), "[0-9]{3,}", m, 30).select("doc_id", "ord", F.lit(m).alias("mode"), "match", F.length("before").cast("long").alias("n_before"), F.length("after").cast("long").alias("n_after")) for m in ("char", "bracket", "comma")]
    return g[0].unionByName(g[1]).unionByName(g[2])


def grep_spans(spark, sf):
    return search.grep(_blocks(spark, sf).select("doc_id", "ord", "text"), "([A-Z])[a-z]*, ([a-z]+)").select("doc_id", "ord", "start", "end", "match", F.array_join("groups", "|").alias("groups"))


def cross_block_grep(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    hits = search.grep_across(c, ["conv_id"], "turn", "[a-z]+\\.\\n[A-Z][a-z]*")
    return hits.select("conv_id", F.col("match_no").cast("long").alias("match_no"), "match", "turn", F.col("slice_start").cast("long").alias("slice_start"), F.col("slice_end").cast("long").alias("slice_end"))


def placeholder_classify(spark, sf):
    return search.placeholders(_templated(spark, sf)).select("doc_id", "ord", F.col("nth").cast("long").alias("nth"), "placeholder", "kind", "hint")


def residue_scan(spark, sf):
    t = _templated(spark, sf).withColumn("text", F.when(F.col("ord") % 7 == 0, F.concat("text", F.lit(" {{name}} ${amount} <<date>> ____ [_] [....] [ENTER date] [TYPED] [TYPE] {{}}"))).otherwise(F.col("text")))
    return search.residue(t).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


def search_replace_case(spark, sf):
    b = _blocks(spark, sf)
    x, y = search.replace_text(F.col("text"), "the", "THE", True), search.replace_text(F.col("text"), "the", "<$1>", False)
    return b.select("doc_id", "ord", F.sha2(x, 256).alias("cased"), F.sha2(y, 256).alias("uncased"))


def fill_placeholders_multipass(spark, sf):
    t = _templated(spark, sf).withColumn("text", F.concat(F.lit("[a[x]] "), "text"))
    filled = search.fill(F.col("text"), {"x": "1", "a1": "done", "____": "0.20", "this / that": "this"})
    return t.select("doc_id", "ord", F.sha2(filled, 256).alias("text_hash"), F.regexp_count(filled, F.lit(search.PLACEHOLDER)).cast("long").alias("still_open"))


def single_characters(spark, sf):
    """How often each character begins a run of its own, by document language."""
    d = load(spark, sf, "documents")
    c = d.select("lang", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return c.groupBy("lang", "c").agg(F.count("*").alias("n"))


def role_runs(spark, sf):
    c = windows.islands(load(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role"), "run")
    return c.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def reply_threads(spark, sf):
    """Every turn replies to the last turn of another role; depth and root of each thread, by a recursive query. A root
    is a turn without such a turn before it."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    c = windows.preceding(c, ["conv_id"], ["turn"], F.col("turn"), "parent", last=-1)
    c.select("conv_id", "turn", "role", "parent").createOrReplaceTempView("quirelake_turns")
    return spark.sql("""WITH RECURSIVE thread(conv_id, turn, root, depth) AS (
      SELECT conv_id, turn, turn, CAST(0 AS BIGINT) FROM quirelake_turns WHERE parent IS NULL
      UNION ALL SELECT t.conv_id, t.turn, thread.root, thread.depth + 1 FROM quirelake_turns t JOIN thread ON t.conv_id = thread.conv_id AND t.parent = thread.turn)
      SELECT conv_id, turn, root, depth FROM thread""")


def section_split(spark, sf):
    """Section number of each block: short blocks begin a section; and what governs it, the last heading before."""
    b = _blocks(spark, sf).select("doc_id", "ord", "text")
    head = F.length("text") < 40
    b = windows.running(b, ["doc_id"], ["ord"], F.sum(head.cast("long")), "section")
    return windows.preceding(b, ["doc_id"], ["ord"], F.when(head, F.col("ord")), "governed_by").select("doc_id", "ord", "section", "governed_by")


def next_heading_range(spark, sf):
    b = _blocks(spark, sf).select("doc_id", "ord", "text")
    level = F.when(F.length("text") < 20, 1).when(F.length("text") < 40, 2)
    b = b.withColumn("level", level)
    w = W.partitionBy("doc_id").orderBy("ord").rowsBetween(1, W.unboundedFollowing)
    end1, end2, last = F.min(F.when(F.col("level") <= 1, F.col("ord"))).over(w), F.min(F.when(F.col("level") <= 2, F.col("ord"))).over(w), F.max("ord").over(W.partitionBy("doc_id")) + 1
    return b.withColumn("end", F.coalesce(F.when(F.col("level") == 1, end1).otherwise(end2), last)).where("level is not null").select("doc_id", "ord", F.col("level").cast("long").alias("level"), F.col("end"))


def html_strip_and_blocks(spark, sf):
    p = load(spark, sf, "pages")
    t = html_text(F.col("html"))
    return p.select("page_id", F.length(t).cast("long").alias("n_chars"), F.sha2(t, 256).alias("text_hash"))


def html_tag_counts(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return p.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def html_links(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("nth", "href"))
    return p.select("page_id", F.col("nth").cast("long").alias("nth"), "href")


def toc_entries(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h([1-6])[^>]*>[^<]*</h"), F.lit(0))).alias("nth", "h"))
    return p.select("page_id", F.col("nth").cast("long").alias("nth"), F.substr("h", F.lit(3), F.lit(1)).cast("long").alias("level"), F.regexp_extract("h", ">([^<]*)<", 1).alias("title"))


def structure_tree_paths(spark, sf):
    """Path ids of page elements: page/p-0, page/h1-0 ..., numbered by type."""
    p = load(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(h1|p|li|nav|article|footer)[ >]"), F.lit(1))).alias("at", "tag"))
    n = F.row_number().over(W.partitionBy("page_id", "tag").orderBy("at")) - 1
    return p.select("page_id", F.col("at").cast("long").alias("at"), F.concat(F.lit("page/"), "tag", F.lit("-"), n.cast("string")).alias("path"))


def markdown_projection(spark, sf):
    """Headings and paragraphs of each page as Markdown with anchors, in order."""
    p = load(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h1>[^<]*</h1>|<p>[^<]*</p>"), F.lit(0))).alias("at", "b"))
    body = F.regexp_extract("b", ">([^<]*)<", 1)
    line = F.when(F.col("b").startswith("<h1"), F.concat(F.lit("# "), body)).otherwise(F.regexp_replace(body, "([*_`#])", "\\\\$1"))
    line = F.concat(F.lit("{#p:body:"), F.col("at").cast("string"), F.lit("} "), line)
    out = p.select("page_id", "at", line.alias("md")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "md"))), lambda x: x["md"]), "\n\n").alias("md"))
    return out.select("page_id", F.length("md").cast("long").alias("n_chars"), F.sha2("md", 256).alias("md_hash"))


def residue_free_quotes(spark, sf):
    """Scalar text functions side by side: smart quotes, valid XML, base64 lines, booleans."""
    b = _blocks(spark, sf)
    q = T.smart_quotes(F.concat(F.lit('He said "'), "text", F.lit('" (")')))
    flag = T.boolean(F.element_at(F.array(F.lit("On"), F.lit("0"), F.lit("x")), (F.col("doc_id") % 3 + 1).cast("int")))
    return b.select("doc_id", "ord", F.sha2(q, 256).alias("quoted"), F.sha2(T.wrap76(F.col("text")), 256).alias("base64"), flag.alias("flag"), F.sha2(T.valid_xml(F.concat(F.lit("a\u0001b\u001f"), "text")), 256).alias("xml"))


_XML = "'a' || chr(1) || 'b' || chr(31) || text"
for _c in range(1, 32):
    _XML = f"replace({_XML}, chr({_c}), '_{_c:X}_')"


QUERIES = {f.__name__: f for f in (find_all_by_text, find_first_by_text, find_by_regex, find_by_kind, block_info_lookup, find_by_label, text_occurrences_overlapping, grep_context_sentence, grep_context_modes, grep_spans, cross_block_grep, placeholder_classify, residue_scan, search_replace_case, fill_placeholders_multipass, single_characters, role_runs, reply_threads, section_split, next_heading_range, html_strip_and_blocks, html_tag_counts, html_links, toc_entries, structure_tree_paths, markdown_projection, residue_free_quotes)}

_PLACE = r"regexp_extract_all(text, '\$?\[[^\[\]]*\]')"
ORACLES = {
    "find_all_by_text": f"WITH {BLOCKS} SELECT doc_id, ord, hash FROM blocks WHERE contains(regexp_replace(translate(lower(text), chr(160), ' '), '[ \\t]+', ' ', 'g'), 'the the')",
    "find_first_by_text": f"WITH {BLOCKS} SELECT doc_id, min(ord) AS ord, arg_min(hash, ord) AS hash FROM blocks WHERE contains(regexp_replace(translate(lower(text), chr(160), ' '), '[ \\t]+', ' ', 'g'), 'que') GROUP BY doc_id",
    "find_by_regex": f"WITH {BLOCKS} SELECT doc_id, ord, len(regexp_extract_all(text, '[0-9]{{4,}}')) AS n FROM blocks WHERE regexp_matches(text, '[0-9]{{4,}}')",
    "find_by_kind": f"WITH {BLOCKS} SELECT * FROM (SELECT doc_id, ord, CASE WHEN trim(text, ' ') = '' THEN 'blank' WHEN length(text) < 40 THEN 'heading' WHEN regexp_matches(text, '^[-*|]|\\|') THEN 'table' ELSE 'paragraph' END AS kind FROM blocks) WHERE kind IN ('heading', 'table')",
    "block_info_lookup": f"WITH {BLOCKS} SELECT d.doc_id, o AS ord, hash IS NOT NULL AS found, CAST(length(blocks.text) AS BIGINT) AS n_chars FROM (SELECT doc_id, CAST(unnest([0, 5, 50]) AS BIGINT) AS o FROM documents) d LEFT JOIN blocks ON blocks.doc_id = d.doc_id AND ord = o",
    "find_by_label": f"WITH {BLOCKS} SELECT doc_id, count(*) AS n_blocks FROM blocks WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1",
    "text_occurrences_overlapping": r"""WITH n AS (SELECT item_id, regexp_extract(text, '^([^ ]+ [^ ]+)', 1) AS needle FROM benchmark), d AS (SELECT doc_id, text, list_distinct(regexp_split_to_array(text, '[ \n]')) AS w FROM documents),
      h AS (SELECT doc_id, item_id, s - 1 AS start FROM d JOIN n ON list_contains(w, string_split(needle, ' ')[1]), LATERAL unnest(range(1, greatest(length(text) - length(needle) + 2, 1))) AS u(s) WHERE needle <> '' AND contains(text, needle) AND substr(text, s, length(needle)) = needle)
      SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY start) - 1 AS nth, start FROM h QUALIFY nth < 100""",
    "grep_context_sentence": rf"""WITH {BLOCKS}, m AS (SELECT doc_id, ord, text, regexp_extract(text, '[A-Z][a-z]+tion') AS match FROM blocks WHERE regexp_matches(text, '[A-Z][a-z]+tion')), p AS (SELECT *, instr(text, match) - 1 AS start FROM m)
      SELECT doc_id, ord, match, CAST(start AS BIGINT) AS start, regexp_extract(substr(text, greatest(start - 59, 1), least(start, 60)), '[^.!?\n]*$') AS before, regexp_extract(substr(text, start + length(match) + 1, 60), '^[^.!?\n]*') AS "after" FROM p""",
    "grep_context_modes": rf"""WITH {BLOCKS}, m AS (SELECT doc_id, ord, text, regexp_extract(text, '[0-9]{{3,}}') AS match FROM blocks WHERE regexp_matches(text, '[0-9]{{3,}}')), p AS (SELECT *, instr(text, match) - 1 AS start FROM m),
      c AS (SELECT *, substr(text, greatest(start - 29, 1), least(start, 30)) AS l, substr(text, start + length(match) + 1, 30) AS r FROM p)
      SELECT doc_id, ord, 'char' AS mode, match, CAST(length(l) AS BIGINT) AS n_before, CAST(length(r) AS BIGINT) AS n_after FROM c
      UNION ALL SELECT doc_id, ord, 'bracket', match, length(regexp_extract(l, '[^\[\]]*$')), length(regexp_extract(r, '^[^\[\]]*')) FROM c
      UNION ALL SELECT doc_id, ord, 'comma', match, length(regexp_extract(l, '[^,.!?;\n]*$')), length(regexp_extract(r, '^[^,.!?;\n]*')) FROM c""",
    "placeholder_classify": rf"""WITH {TEMPLATED}, e AS (SELECT doc_id, ord, i - 1 AS nth, p[i] AS placeholder FROM (SELECT doc_id, ord, {_PLACE} AS p FROM tpl), LATERAL unnest(range(1, len(p) + 1)) AS u(i)),
      k AS (SELECT *, regexp_replace(placeholder, '^\$?\[|\]$', '', 'g') AS x FROM e)
      SELECT doc_id, ord, nth, placeholder, CASE WHEN regexp_matches(x, '^[_ ]*$') THEN 'blank' WHEN regexp_matches(x, '(?i)^\*|insert|specify|note') THEN 'instruction' WHEN regexp_matches(x, '/| or ') THEN 'alternative' ELSE 'fill' END AS kind, trim(regexp_replace(x, '[*_]+', '', 'g'), ' ') AS hint FROM k""",
    "residue_scan": rf"""WITH {TEMPLATED}, t AS (SELECT doc_id, ord, CASE WHEN ord % 7 = 0 THEN text || ' {{{{name}}}} ${{amount}} <<date>> ____ [_] [....] [ENTER date] [TYPED] [TYPE] {{{{}}}}' ELSE text END AS text FROM tpl),
      m AS (SELECT doc_id, 'double_brace' AS code, len(regexp_extract_all(text, '\{{\{{[^{{}}\r\n]{{1,256}}\}}\}}')) AS n FROM t UNION ALL SELECT doc_id, 'dollar_brace', len(regexp_extract_all(text, '\$\{{[^{{}}\r\n]{{1,256}}\}}')) FROM t UNION ALL SELECT doc_id, 'angle_placeholder', len(regexp_extract_all(text, '<<[^<>\r\n]{{1,256}}>>')) FROM t
        UNION ALL SELECT doc_id, 'explicit_bracket_placeholder', len(regexp_extract_all(text, '\[(?:_{{3,}}|\.{{3,}}|(?:INSERT|ENTER|TYPE)\b[^\]\r\n]{{0,192}})\]')) FROM t UNION ALL SELECT doc_id, 'underscore', len(regexp_extract_all(text, '_{{3,}}')) FROM t)
      SELECT doc_id, code, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ALL HAVING sum(n) > 0""",
    "residue_free_quotes": rf"""WITH {BLOCKS} SELECT doc_id, ord, sha256(regexp_replace(regexp_replace('He said "' || text || '" (")', '(^|[ (\[])"', '\1' || chr(8220), 'g'), '"', chr(8221), 'g')) AS quoted,
      sha256(rtrim(regexp_replace(base64(encode(text)), '(.{{76}})', '\1' || chr(10), 'g'), chr(10))) AS base64, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, sha256({_XML}) AS xml FROM blocks""",
    "search_replace_case": f"WITH {BLOCKS} SELECT doc_id, ord, sha256(replace(text, 'the', 'THE')) AS cased, sha256(regexp_replace(text, 'the', '<$1>', 'gi')) AS uncased FROM blocks",
    "fill_placeholders_multipass": rf"""WITH {TEMPLATED}, f AS (SELECT doc_id, ord, replace(replace(replace(replace('[a[x]] ' || text, '[x]', '1'), '[a1]', 'done'), '[____]', '0.20'), '[this / that]', 'this') AS text FROM tpl)
      SELECT doc_id, ord, sha256(text) AS text_hash, len({_PLACE}) AS still_open FROM f""",
    "single_characters": "SELECT lang, c, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL",
    "role_runs": """WITH c AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c) SELECT conv_id, run, min(role) AS role, count(*) AS n, min(turn) AS first_turn, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM r GROUP BY ALL""",
    "reply_threads": "SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS root, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM conversations",
    "section_split": f"WITH {BLOCKS} SELECT doc_id, ord, CAST(sum(CASE WHEN length(text) < 40 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS section, max(CASE WHEN length(text) < 40 THEN ord END) OVER w AS governed_by FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)",
    "next_heading_range": f"""WITH {BLOCKS}, l AS (SELECT doc_id, ord, n, CASE WHEN length(text) < 20 THEN 1 WHEN length(text) < 40 THEN 2 END AS level FROM blocks),
      e AS (SELECT *, min(CASE WHEN level <= 1 THEN ord END) OVER w AS e1, min(CASE WHEN level <= 2 THEN ord END) OVER w AS e2 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
      SELECT doc_id, ord, CAST(level AS BIGINT) AS level, CAST(coalesce(CASE WHEN level = 1 THEN e1 ELSE e2 END, n) AS BIGINT) AS "end" FROM e WHERE level IS NOT NULL""",
    "html_strip_and_blocks": r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') AS t FROM pages)
      SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_hash FROM t""",
    "html_tag_counts": "SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL",
    "html_links": """SELECT page_id, i - 1 AS nth, h[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages), LATERAL unnest(range(1, len(h) + 1)) AS u(i)""",
    "toc_entries": """SELECT page_id, i - 1 AS nth, CAST(substr(h[i], 3, 1) AS BIGINT) AS level, regexp_extract(h[i], '>([^<]*)<', 1) AS title FROM (SELECT page_id, regexp_extract_all(html, '<h([1-6])[^>]*>[^<]*</h') AS h FROM pages), LATERAL unnest(range(1, len(h) + 1)) AS u(i)""",
    "structure_tree_paths": """WITH e AS (SELECT page_id, i - 1 AS pos, h[i] AS tag FROM (SELECT page_id, regexp_extract_all(html, '<(h1|p|li|nav|article|footer)[ >]', 1) AS h FROM pages), LATERAL unnest(range(1, len(h) + 1)) AS u(i))
      SELECT page_id, pos AS "at", 'page/' || tag || '-' || (row_number() OVER (PARTITION BY page_id, tag ORDER BY pos) - 1) AS path FROM e""",
    "markdown_projection": r"""WITH e AS (SELECT page_id, i - 1 AS pos, h[i] AS b FROM (SELECT page_id, regexp_extract_all(html, '<h1>[^<]*</h1>|<p>[^<]*</p>') AS h FROM pages), LATERAL unnest(range(1, len(h) + 1)) AS u(i)),
      m AS (SELECT page_id, string_agg('{#p:body:' || pos || '} ' || CASE WHEN starts_with(b, '<h1') THEN '# ' || regexp_extract(b, '>([^<]*)<', 1) ELSE regexp_replace(regexp_extract(b, '>([^<]*)<', 1), '([*_`#])', '\\\1', 'g') END, chr(10) || chr(10) ORDER BY pos) AS md FROM e GROUP BY 1)
      SELECT page_id, CAST(length(md) AS BIGINT) AS n_chars, sha256(md) AS md_hash FROM m""",
}
ORACLES["grep_spans"] = f"""WITH RECURSIVE {BLOCKS}, m AS (
  SELECT doc_id, ord, text, regexp_extract_all(text, '([A-Z])[a-z]*, ([a-z]+)') AS ms FROM blocks
), r AS (
  SELECT doc_id, ord, text, ms, 1 AS i, CAST(instr(text, ms[1]) - 1 AS BIGINT) AS start FROM m WHERE len(ms) > 0
  UNION ALL SELECT doc_id, ord, text, ms, i + 1, CAST(start + length(ms[i]) + instr(substr(text, start + length(ms[i]) + 1), ms[i + 1]) - 1 AS BIGINT) FROM r WHERE i < len(ms)
)
SELECT doc_id, ord, start, start + length(ms[i]) AS "end", ms[i] AS match, left(ms[i], 1) || '|' || regexp_extract(ms[i], '([A-Z])[a-z]*, ([a-z]+)', 2) AS groups FROM r"""
