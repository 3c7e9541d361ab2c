"""Queries over document blocks: scan, hashes, alignment, revisions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.functions import text as T
from quirelake.operators import align
from quirelake.sources.store import stored
from quirelake.sources.tables import blocks, load, offsets, revised

BLOCKS = """blocks AS (SELECT doc_id, i - 1 AS ord, p[i] AS text, sha256(p[i]) AS hash, len(p) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), LATERAL unnest(range(1, len(p) + 1)) AS u(i))"""
REVISED = BLOCKS + """, kept AS (
  SELECT doc_id, CASE WHEN n >= 4 AND ord = n - 1 THEN -1 ELSE ord END AS place, CASE WHEN n >= 4 AND ord = 2 THEN text || ' edited here' ELSE text END AS text
  FROM blocks WHERE NOT (n >= 4 AND ord = 1)
  UNION ALL SELECT doc_id, 1000000000, 'appended block of ' || doc_id FROM blocks WHERE n >= 4 AND ord = 0
), rev AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS ord, text, sha256(text) AS hash FROM kept),
pairs AS (
  SELECT l.doc_id, l.hash, l.ord AS left_ord, r.ord AS right_ord
  FROM (SELECT doc_id, hash, min(ord) AS ord FROM blocks GROUP BY ALL HAVING count(*) = 1) l JOIN (SELECT doc_id, hash, min(ord) AS ord FROM rev GROUP BY ALL HAVING count(*) = 1) r USING (doc_id, hash)
), crossed AS (
  SELECT *, coalesce(max(right_ord) OVER (PARTITION BY doc_id ORDER BY left_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > right_ord, false) AS moved FROM pairs
)"""
TOKENS = r"""list_transform(regexp_extract_all(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({0}, chr(160), ' '), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9]),([0-9])', '\1' || chr(57345) || '\2', 'g'),
    '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9]),([0-9])', '\1' || chr(57345) || '\2', 'g'),
  '[^ \-)(;,:.、。，：；（）]+|[ \-)(;,:.、。，：；（）]'), lambda x: replace(replace(x, chr(57344), '.'), chr(57345), ','))"""
WORDS = "list_transform(list_filter(" + TOKENS + r", lambda x: NOT regexp_full_match(x, '[ \-)(;,:.、。，：；（）]')), lambda x: lower(x))"


def _both(spark, sf):
    left = blocks(load(spark, sf, "documents"))
    return left, revised(left)


def blocks_scan(spark, sf):
    return offsets(blocks(load(spark, sf, "documents"))).select("doc_id", "ord", "hash", "start_offset", "end_offset", T.short_hash(F.col("text")).alias("short_hash"), T.preview(F.col("text"), 20).alias("preview"))


def flagship_block_diff_counts(spark, sf):
    left, right = _both(spark, sf)
    pairs = align.crossing(align.unique_hash_join(left, right))
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    met = pairs.groupBy("doc_id").agg(F.count("*").alias("m"), F.count_if(~F.col("moved")).alias("n_equal"), F.count_if("moved").alias("n_moved"))
    out = n(left, "l").join(n(right, "r"), "doc_id").join(met, "doc_id", "left").na.fill(0)
    return out.select("doc_id", "n_equal", "n_moved", (F.col("l") - F.col("m")).alias("n_deleted"), (F.col("r") - F.col("m")).alias("n_inserted"))


def unique_hash_anchors(spark, sf):
    left, right = _both(spark, sf)
    pairs = align.crossing(align.unique_hash_join(left, right)).where("not moved")
    return align.spine_gaps(pairs.select("doc_id", "left_ord", "right_ord"))


def duplicate_block_hashes(spark, sf):
    b = blocks(load(spark, sf, "documents")).where(F.trim("text") != "")
    return b.groupBy("hash").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n > 1")


def occurrence_numbered_blocks(spark, sf):
    b = blocks(load(spark, sf, "documents"))
    unid = F.concat_ws(":", F.lit("p"), F.lit("body"), F.left(F.sha2(F.concat_ws("#", "hash", F.col("occurrence").cast("string")), 256), F.lit(32)))
    b = b.withColumn("occurrence", (F.row_number().over(W.partitionBy("doc_id", "hash").orderBy("ord")) - 1).cast("long"))
    return b.select("doc_id", "ord", "occurrence", unid.alias("anchor"))


def tokenize_words(spark, sf):
    b = blocks(load(spark, sf, "documents")).withColumn("t", T.tokens(F.col("text")))
    w = F.filter("t", T.is_word)
    return b.select("doc_id", "ord", F.size("t").cast("long").alias("n_tokens"), F.size(w).cast("long").alias("n_words"), F.sha2(F.array_join("t", "|"), 256).alias("tokens_hash"), F.sha2(F.array_join(F.transform(w, lambda x: F.lower(x)), "|"), 256).alias("keys_hash"))


def block_multiset_jaccard(spark, sf):
    left, right = _both(spark, sf)
    pairs = align.unique_hash_join(left, right)
    return align.bag_similarity(align.residue(left, pairs, "left"), align.residue(right, pairs, "right"))


def set_jaccard_moves(spark, sf):
    left, right = _both(spark, sf)
    pairs = align.unique_hash_join(left, right)
    return align.set_similarity(align.residue(left, pairs, "left"), align.residue(right, pairs, "right"), least=0.5)


def mutual_best_moves(spark, sf):
    return align.mutual_best(block_multiset_jaccard(spark, sf), 0.35)


def distinct_in_order(spark, sf):
    b = blocks(load(spark, sf, "documents"))
    first = b.groupBy("doc_id", "hash").agg(F.min("ord").alias("ord"))
    return first.select("doc_id", "hash", "ord", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")).cast("long").alias("nth"))


def skip_last_blocks(spark, sf):
    b = blocks(load(spark, sf, "documents"))
    last = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("ord").desc()))
    return b.withColumn("back", last).where("back > 2").select("doc_id", "ord", "hash")


def edit_script_ops(spark, sf):
    return align.edit_script(*_both(spark, sf)).select("doc_id", "seq", "op", "left_ord", "right_ord")


def edit_script_apply_invariant(spark, sf):
    """Documents for which applying the script doesn't give the other version: none."""
    left, right = _both(spark, sf)
    right = stored(right, "revised")
    script = align.edit_script(left, right)
    digest = lambda df, *names: df.withColumns({n: F.unhex(F.sha2(n, 256)) for n in names})
    left, right, script = digest(left, "text"), digest(right, "text"), digest(script, "left_text", "right_text")

    def lost(got, want, side):  # rows of either that the other hasn't, as often
        both = got.select("doc_id", "ord", "text", F.lit(1).alias("n")).unionByName(want.select("doc_id", "ord", "text", F.lit(-1).alias("n")))
        return both.groupBy("doc_id", "ord", "text").agg(F.abs(F.sum("n")).alias("n")).where("n > 0").select(F.lit(side).alias("side"), "n")

    wrong = lost(align.accepted(script), right, "accept").unionByName(lost(align.rejected(script), left, "reject"))
    return wrong.groupBy("side").agg(F.sum("n").alias("n")).join(spark.createDataFrame([("accept",), ("reject",)], "side string"), "side", "right").select("side", F.coalesce("n", F.lit(0)).cast("long").alias("n_wrong"))


def revision_list(spark, sf):
    return align.revisions(align.edit_script(*_both(spark, sf))).select("doc_id", "seq", "part", "kind", F.sha2("text", 256).alias("text_hash"), "move_group")


def token_diff_spans(spark, sf):
    script = align.edit_script(*_both(spark, sf)).where("op = 'Modify'")
    return align.token_diff(script.select("doc_id", "seq", "left_text", "right_text"), ["doc_id", "seq"])


def lis_spine_length(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("left_ord"), F.col("o_totalprice").alias("right_ord"))
    s = align.spine(o)
    return s.groupBy("doc_id").agg(F.count_if("on_spine").alias("spine"), F.count("*").alias("n"))


def split_merge_candidates(spark, sf):
    """A left block whose words two adjacent right blocks hold (here: halves of a block), by coverage."""
    # words come out of an explode, through which no filter is pushed: a block is cut once, not for the filter and again
    b = blocks(load(spark, sf, "documents")).select("doc_id", "ord", F.explode(F.array(T.words(F.col("text")))).alias("w")).where(F.size("w") >= 6)
    half = F.floor(F.size("w") / 2).cast("int")
    parts = b.select("doc_id", "ord", "w", F.posexplode(F.array(F.slice("w", F.lit(1), half), F.slice("w", half + 1, F.size("w")))).alias("part", "pw"))
    # likewise the foreign words, which a filter would otherwise find again for each word
    parts = parts.withColumn("foreign", F.explode(F.array(F.array_except("pw", "w"))))
    met = parts.select("doc_id", "ord", F.size("w").alias("n"), F.size("pw").alias("m"), F.size(F.filter("pw", lambda x: ~F.array_contains("foreign", x))).alias("hit"))
    run = met.groupBy("doc_id", "ord").agg(F.max("n").alias("n"), F.sum("hit").alias("hit"), F.sum("m").alias("m"))
    return run.select("doc_id", "ord", F.round(F.col("hit") / F.col("n"), 6).alias("coverage"), F.round(1 - F.col("hit") / F.col("m"), 6).alias("foreign")).where("coverage >= 0.9 and foreign <= 0.34")


def accept_reject_roundtrip(spark, sf):
    script = align.edit_script(*_both(spark, sf))
    digest = lambda df, name: df.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n"), 256).alias(name))
    return digest(align.accepted(script), "accepted").join(digest(align.rejected(script), "rejected"), "doc_id")


QUERIES = {f.__name__: f for f in (blocks_scan, flagship_block_diff_counts, unique_hash_anchors, duplicate_block_hashes, occurrence_numbered_blocks, tokenize_words, block_multiset_jaccard, set_jaccard_moves, mutual_best_moves, distinct_in_order, skip_last_blocks, edit_script_ops, edit_script_apply_invariant, revision_list, token_diff_spans, lis_spine_length, split_merge_candidates, accept_reject_roundtrip)}

_RESIDUE = REVISED + f""", lres AS (SELECT doc_id, ord, unnest({WORDS.format('text')}) AS w FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = b.doc_id AND p.left_ord = b.ord)),
rres AS (SELECT doc_id, ord, unnest({WORDS.format('text')}) AS w FROM rev b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = b.doc_id AND p.right_ord = b.ord)),
lb AS (SELECT doc_id, ord, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id, ord) AS size FROM lres GROUP BY doc_id, ord, w), rb AS (SELECT doc_id, ord, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id, ord) AS size FROM rres GROUP BY doc_id, ord, w),
bagged AS (SELECT lb.doc_id, lb.ord AS left_ord, rb.ord AS right_ord, round(sum(least(lb.n, rb.n)) / (max(lb.size) + max(rb.size) - sum(least(lb.n, rb.n))), 6) AS score FROM lb JOIN rb USING (doc_id, w) GROUP BY ALL),
setted AS (SELECT lb.doc_id, lb.ord AS left_ord, rb.ord AS right_ord, count(*) AS met, max(lc.k) AS ls, max(rc.k) AS rs
  FROM lb JOIN rb USING (doc_id, w) JOIN (SELECT doc_id, ord, count(*) AS k, max(size) AS s FROM lb GROUP BY ALL) lc ON lc.doc_id = lb.doc_id AND lc.ord = lb.ord AND lc.s >= 3
  JOIN (SELECT doc_id, ord, count(*) AS k, max(size) AS s FROM rb GROUP BY ALL) rc ON rc.doc_id = rb.doc_id AND rc.ord = rb.ord AND rc.s >= 3 GROUP BY ALL)"""

ORACLES = {
    "blocks_scan": f"""WITH {BLOCKS} SELECT doc_id, ord, hash, CAST(e - length(text) AS BIGINT) AS start_offset, CAST(e AS BIGINT) AS end_offset, substr(hash, 1, 16) AS short_hash,
      CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS preview FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS e FROM blocks)""",
    "flagship_block_diff_counts": f"""WITH {REVISED}, m AS (SELECT doc_id, count(*) AS m, count(*) FILTER (NOT moved) AS e, count(*) FILTER (moved) AS v FROM crossed GROUP BY 1)
      SELECT l.doc_id, coalesce(e, 0) AS n_equal, coalesce(v, 0) AS n_moved, l.c - coalesce(m, 0) AS n_deleted, r.c - coalesce(m, 0) AS n_inserted
      FROM (SELECT doc_id, count(*) AS c FROM blocks GROUP BY 1) l JOIN (SELECT doc_id, count(*) AS c FROM rev GROUP BY 1) r USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "unique_hash_anchors": f"WITH {REVISED} SELECT doc_id, left_ord, right_ord, row_number() OVER (PARTITION BY doc_id ORDER BY left_ord) - 1 AS gap_id FROM crossed WHERE NOT moved",
    "duplicate_block_hashes": f"WITH {BLOCKS} SELECT hash, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM blocks WHERE trim(text, ' ') <> '' GROUP BY 1 HAVING count(*) > 1",
    "occurrence_numbered_blocks": f"""WITH {BLOCKS}, o AS (SELECT doc_id, ord, hash, row_number() OVER (PARTITION BY doc_id, hash ORDER BY ord) - 1 AS occurrence FROM blocks)
      SELECT doc_id, ord, occurrence, 'p:body:' || substr(sha256(hash || '#' || occurrence), 1, 32) AS anchor FROM o""",
    "tokenize_words": f"""WITH {BLOCKS}, t AS (SELECT doc_id, ord, {TOKENS.format('text')} AS t, {WORDS.format('text')} AS w FROM blocks)
      SELECT doc_id, ord, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(w) AS BIGINT) AS n_words, sha256(coalesce(array_to_string(t, '|'), '')) AS tokens_hash, sha256(coalesce(array_to_string(w, '|'), '')) AS keys_hash FROM t""",
    "block_multiset_jaccard": f"WITH {_RESIDUE} SELECT * FROM bagged",
    "set_jaccard_moves": f"WITH {_RESIDUE} SELECT * FROM (SELECT doc_id, left_ord, right_ord, round(met / (ls + rs - met), 6) AS score FROM setted) WHERE score >= 0.5",
    "mutual_best_moves": f"""WITH {_RESIDUE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, left_ord ORDER BY score DESC, left_ord, right_ord) AS a, row_number() OVER (PARTITION BY doc_id, right_ord ORDER BY score DESC, left_ord, right_ord) AS b FROM bagged WHERE score >= 0.35)
      SELECT doc_id, left_ord, right_ord, score FROM r WHERE a = 1 AND b = 1""",
    "distinct_in_order": f"WITH {BLOCKS} SELECT doc_id, hash, min(ord) AS ord, row_number() OVER (PARTITION BY doc_id ORDER BY min(ord)) AS nth FROM blocks GROUP BY doc_id, hash",
    "skip_last_blocks": f"WITH {BLOCKS} SELECT doc_id, ord, hash FROM blocks WHERE ord < n - 2",
    "edit_script_apply_invariant": "SELECT * FROM (VALUES ('accept', CAST(0 AS BIGINT)), ('reject', CAST(0 AS BIGINT))) t(side, n_wrong)",
    "split_merge_candidates": f"""WITH {BLOCKS}, b AS (SELECT doc_id, ord, {WORDS.format('text')} AS w FROM blocks) SELECT doc_id, ord, CAST(1 AS DOUBLE) AS coverage, CAST(0 AS DOUBLE) AS "foreign" FROM b WHERE len(w) >= 6""",
    "accept_reject_roundtrip": f"""WITH {REVISED} SELECT doc_id, a AS accepted, r AS rejected FROM (SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY ord)) AS a FROM rev GROUP BY 1) JOIN (SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY ord)) AS r FROM blocks GROUP BY 1) USING (doc_id)""",
}
