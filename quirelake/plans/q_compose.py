"""Queries on N-way merging: three reviewers of every document, whose edits compose, agree or conflict."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.operators import compose
from quirelake.plans.q_blocks import BLOCKS
from quirelake.sources.tables import blocks, load


def _versions(spark, sf):
    """Blocks of six words or more that occur once in their document are edited: reviewer 1 replaces the first word, 2 the
    last one, 3 the last one by another word in each fourth block. In each seventh block reviewer 2 deletes instead, and so
    does reviewer 3. All append a block of their own, and 1 and 3 one more that is the same."""
    b = blocks(load(spark, sf, "documents"))
    w = F.split("text", " ")
    fit = (F.size(w) >= 6) & ~F.array_contains(w, "") & (F.count("*").over(W.partitionBy("doc_id", "hash")) == 1)
    e = b.withColumns({"w": w, "fit": fit, "n": F.count("*").over(W.partitionBy("doc_id"))}).withColumn("reviewer", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    gone = F.col("fit") & (F.col("ord") % 7 == 3) & (F.col("reviewer") > 1)
    head, tail = F.concat_ws(" ", F.lit("alpha1"), F.expr("array_join(slice(w, 2, size(w)), ' ')")), lambda x: F.concat(F.expr("array_join(slice(w, 1, size(w) - 1), ' ')"), F.lit(x))
    text = F.when(~F.col("fit"), F.col("text")).when(F.col("reviewer") == 1, head).when(F.col("reviewer") == 2, tail(" omega2")).when(F.col("ord") % 4 == 0, tail(" omega3")).otherwise(F.col("text"))
    # one pass, without a union: the windows over a document share one shuffle
    note = lambda at, t: F.struct((F.col("n") + at).alias("ord"), t.alias("text"))
    first = F.col("ord") == 0
    rows = F.array(F.when(~gone, F.struct("ord", text.alias("text"))), F.when(first, note(0, F.concat(F.lit("closing-note-of-"), F.col("reviewer").cast("string")))), F.when(first & (F.col("reviewer") != 2), note(1, F.lit("joint-note"))))
    more = e.select("doc_id", "reviewer", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("doc_id", "reviewer", "x.*")
    at = F.row_number().over(W.partitionBy("doc_id", "reviewer").orderBy("ord")) - 1
    return b, more.select("doc_id", "reviewer", at.cast("long").alias("ord"), "text", F.sha2("text", 256).alias("hash"))


def _consolidated(policy: str):
    def query(spark, sf):
        base, versions = _versions(spark, sf)
        return compose.consolidated(base, versions, policy).select("doc_id", "ord", F.sha2("text", 256).alias("text_hash"), "status")

    return query


def consolidation_contested_words(spark, sf):
    """The words that two reviewers replace differently, with every competitor."""
    base, versions = _versions(spark, sf)
    found = compose.by_document(base, versions, compose.contested_words, "left_ord long, lo long, hi long, reviewer int, text string")
    return found.withColumn("reviewer", F.col("reviewer").cast("long"))


QUERIES = {f"consolidate_{p}": _consolidated(p) for p in compose.POLICIES} | {"consolidation_contested_words": consolidation_contested_words}

MARKED = BLOCKS + """, m AS (
  SELECT *, string_split(text, ' ') AS w, array_to_string(string_split(text, ' ')[2:], ' ') AS rest, array_to_string(string_split(text, ' ')[:-2], ' ') AS body, array_to_string(string_split(text, ' ')[2:-2], ' ') AS middle,
    len(string_split(text, ' ')) >= 6 AND NOT list_contains(string_split(text, ' '), '') AND count(*) OVER (PARTITION BY doc_id, hash) = 1 AS fit FROM blocks
)"""
_SQL = "WITH " + MARKED + """, r AS (
  SELECT doc_id, ord AS after, 0 AS k, CASE WHEN NOT fit THEN text WHEN ord % 7 = 3 THEN {block} WHEN ord % 4 = 0 THEN 'alpha1 ' || middle || {words} ELSE 'alpha1 ' || middle || ' omega2' END AS text,
    CASE WHEN NOT fit THEN 'equal' WHEN ord % 7 = 3 OR ord % 4 = 0 THEN 'conflict' ELSE 'composed' END AS status FROM m
  UNION ALL SELECT doc_id, 1000000000, k, t, s FROM (SELECT DISTINCT doc_id FROM m), (VALUES (1, 'closing-note-of-1', 'single'), (2, 'joint-note', 'consensus'), (3, 'closing-note-of-2', 'single'), (4, 'closing-note-of-3', 'single')) v(k, t, s)
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY after, k) - 1 AS ord, sha256(text) AS text_hash, status FROM r"""
ORACLES = {
    "consolidate_baseWins": _SQL.format(block="text", words="' ' || w[-1]"),
    "consolidate_firstReviewerWins": _SQL.format(block="'alpha1 ' || rest", words="' omega2'"),
    "consolidate_stackAll": _SQL.format(block="'alpha1 ' || rest", words="' omega2omega3'"),
    "consolidation_contested_words": "WITH " + MARKED + """
SELECT doc_id, ord AS left_ord, length(body) + 1 AS lo, length(text) AS hi, r AS reviewer, 'omega' || r AS text FROM m, (VALUES (CAST(2 AS BIGINT)), (CAST(3 AS BIGINT))) v(r) WHERE fit AND ord % 4 = 0 AND ord % 7 <> 3""",
}
