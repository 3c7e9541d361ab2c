"""Queries on edit scripts of all kinds, over a revision of every document that splits, merges and moves boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.operators import script
from quirelake.plans.q_blocks import BLOCKS
from quirelake.sources.tables import blocks, load


def reworked(b):
    """A revision of documents of nine blocks or more. If they have so many words: the second block is split in two halves,
    the fourth and fifth are merged, the last three words of the seventh go to the head of the eighth. Each second block of
    the others is bold. Words are cut at single spaces."""
    n = F.count("*").over(W.partitionBy("doc_id"))
    here = W.partitionBy("doc_id").orderBy("ord")
    b = b.withColumns({"n": n, "before": F.lag("text").over(here), "after": F.lead("text").over(here)})
    # only blocks that may be changed, and those beside them, are cut into words
    near = (F.col("n") >= 9) & F.col("ord").between(1, 7)
    b = b.withColumns({w: F.when(near, F.split(c, " ")) for w, c in (("w", "text"), ("bw", "before"), ("aw", "after"))})
    b = b.withColumns({"splits": planted(b, 1), "merges": planted(b, 3), "crosses": planted(b, 6), "half": F.floor(F.size("w") / 2).cast("int")})
    was = lambda c: F.coalesce(F.lag(c).over(here), F.lit(False))
    b = b.withColumns({"merged": was("merges"), "crossed": was("crosses")})
    join = lambda x: F.array_join(x, " ")
    text = F.when(F.col("merges"), F.array(F.concat_ws(" ", "text", "after"))).when(F.col("merged"), F.array().cast("array<string>")).when(
        F.col("splits"), F.array(join(F.slice("w", F.lit(1), F.col("half"))), join(F.slice("w", F.col("half") + 1, F.size("w"))))).when(
        F.col("crosses"), F.array(join(F.slice("w", F.lit(1), F.size("w") - 3)))).when(
        F.col("crossed"), F.array(F.concat_ws(" ", join(F.slice("bw", F.size("bw") - 2, F.lit(3))), "text"))).otherwise(F.array("text"))
    out = b.select("doc_id", "ord", F.posexplode(text).alias("part", "text"))
    fmt = F.when((F.col("ord") % 2 == 1), "bold").otherwise("plain")
    return out.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("ord", "part")) - 1).cast("long").alias("ord"), "text", F.sha2("text", 256).alias("hash"), fmt.alias("format"))


def planted(b, ord_: int):
    """Whether the change at that block is made: it, and the block after it, have twelve words or more, all different."""
    long = lambda c: (F.size(c) >= 12) & (F.size(F.array_distinct(c)) == F.size(c)) & ~F.array_contains(c, "")
    return F.coalesce((F.col("n") >= 9) & (F.col("ord") == ord_) & long("w") & long("aw"), F.lit(False))


def _script(spark, sf, texts=True):
    b = blocks(load(spark, sf, "documents"))
    left = b.withColumn("format", F.lit("plain"))
    return left, reworked(b), script.full_script(left, reworked(b), texts=texts)


def script_kinds(spark, sf):
    """The operations of each document by kind; of the kinds that other versions can't be told apart by, in one row each."""
    _, _, s = _script(spark, sf, texts=False)
    return s.groupBy("doc_id", "op").agg(F.count("*").alias("n"), F.sum(F.size("left_ords")).alias("n_left"), F.sum(F.size("right_ords")).alias("n_right"))


def script_structure_found(spark, sf):
    """Documents with planted changes, and the first block of what was found as split, merged and crossing."""
    _, _, s = _script(spark, sf, texts=False)
    first = lambda op, at: F.min(F.when((F.col("op") == op) & F.array_contains("left_ords", F.lit(at).cast("long")), F.array_join(F.col("left_ords").cast("array<string>"), ",")))
    return s.groupBy("doc_id").agg(first("Split", 1).alias("split"), first("Merge", 3).alias("merged"), first("CrossParagraphRun", 6).alias("crossed")).where("coalesce(split, merged, crossed) is not null")


def script_both_versions(spark, sf):
    """Digest of each version of a document as it comes from accepting or rejecting its script."""
    _, _, s = _script(spark, sf)
    told = lambda side: script.version(s, side).groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n"), 256).alias("digest")).withColumn("side", F.lit(side))
    return told("left").unionByName(told("right"))


def script_json_versions(spark, sf):
    """Digest of each version as it comes from the script after it has been written as JSON and read again."""
    _, _, s = _script(spark, sf)
    again = script.script_from_json(script.script_json(s))
    told = lambda side: script.version(again, side).groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n"), 256).alias("digest")).withColumn("side", F.lit(side))
    return told("left").unionByName(told("right"))


def scoped_script_ops(spark, sf):
    """First blocks are headers, last ones footers and the rest the body. In the new version headers are marked, and the
    second block is gone where there are three or more and no text is repeated."""
    b = blocks(load(spark, sf, "documents"))
    w = W.partitionBy("doc_id")
    b = b.withColumns({"n": F.count("*").over(w), "kinds": F.size(F.collect_set("hash").over(w))}).where("n >= 3 and kinds = n")
    scope = F.when(F.col("ord") == 0, "headers").when(F.col("ord") == F.col("n") - 1, "footers").otherwise("body")
    left = b.select("doc_id", "ord", scope.alias("scope"), "text", "hash")
    text = F.when(F.col("scope") == "headers", F.lit("an entirely other header")).otherwise(F.col("text"))
    right = left.where("ord <> 1").withColumn("text", text).withColumn("hash", F.sha2("text", 256))
    s = script.scoped_script(left, right, texts=False)
    return s.groupBy("doc_id", "scope", "op").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (script_kinds, script_structure_found, script_both_versions, script_json_versions, scoped_script_ops)}

LONG = "len({0}) >= 12 AND len(list_distinct({0})) = len({0}) AND NOT list_contains({0}, '')"
REWORKED = BLOCKS + f""", cut AS (
  SELECT *, string_split(text, ' ') AS w, string_split(lag(text) OVER d, ' ') AS bw, string_split(lead(text) OVER d, ' ') AS aw, lead(text) OVER d AS after FROM blocks WINDOW d AS (PARTITION BY doc_id ORDER BY ord)
), plant AS (
  SELECT *, coalesce(n >= 9 AND ord IN (1, 3, 6) AND {LONG.format('w')} AND {LONG.format('aw')}, false) AS planted FROM cut
), told AS (
  SELECT *, coalesce(lag(planted) OVER (PARTITION BY doc_id ORDER BY ord), false) AS next_to FROM plant
), rev AS (
  SELECT doc_id, ord, unnest(CASE WHEN planted AND ord = 3 THEN [text || ' ' || after] WHEN next_to AND ord = 4 THEN [] WHEN planted AND ord = 1 THEN [array_to_string(w[:len(w) // 2], ' '), array_to_string(w[len(w) // 2 + 1:], ' ')]
    WHEN planted AND ord = 6 THEN [array_to_string(w[:len(w) - 3], ' ')] WHEN next_to AND ord = 7 THEN [array_to_string(bw[len(bw) - 2:], ' ') || ' ' || text] ELSE [text] END) AS text,
    unnest([1, 2]) AS part FROM told
)"""
ORACLES = {
    "script_structure_found": f"""WITH {REWORKED}
SELECT doc_id, max(CASE WHEN ord = 1 THEN '1' END) AS split, max(CASE WHEN ord = 3 THEN '3,4' END) AS merged, max(CASE WHEN ord = 6 THEN '6,7' END) AS crossed FROM told WHERE planted GROUP BY doc_id""",
    "script_both_versions": f"""WITH {REWORKED}
SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY ord)) AS digest, 'left' AS side FROM blocks GROUP BY doc_id
UNION ALL SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY ord, part)), 'right' FROM rev WHERE text IS NOT NULL GROUP BY doc_id""",
}
ORACLES["script_json_versions"] = ORACLES["script_both_versions"]
ORACLES["scoped_script_ops"] = f"""WITH {BLOCKS}, d AS (
  SELECT doc_id, count(*) AS n, max(ord) AS last FROM blocks GROUP BY doc_id HAVING count(*) >= 3 AND count(DISTINCT hash) = count(*)
), o AS (
  SELECT doc_id, unnest([{{'s': 'headers', 'o': 'Delete', 'n': 1}}, {{'s': 'headers', 'o': 'Insert', 'n': 1}}, {{'s': 'body', 'o': 'Delete', 'n': 1}}, {{'s': 'body', 'o': 'Equal', 'n': n - 3}}, {{'s': 'footers', 'o': 'Equal', 'n': 1}}]) AS x FROM d
)
SELECT doc_id, x.s AS scope, x.o AS op, CAST(x.n AS BIGINT) AS n FROM o WHERE x.n > 0"""
