"""Benchmark decontamination with a distributed positional inverted index. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import common

WINDOW = 10
#: What separates words once A-Z is lowered.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that a benchmark row takes when broadcast, more than any of the tables made here has.
ROW_BYTES = 256


def words(text):
    """The lower-cased words of a text column; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def n_words(text: str):
    """How many words words() finds; letters needn't be lowered to be counted."""
    apart = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), apart), "")).cast("long")


def text_key(text="text"):
    """128 bits that stand for a text. What a document holds depends on its text alone, so equal texts are one in the index
    and no id, null or repeated, matters."""
    return F.unhex(F.md5(text))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional inverted index of docs for some terms: term, text_key, positions. The terms are broadcast if they are
    few enough, else joined by a shuffle."""
    rows = docs.select(text_key().alias("text_key"), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    rows = rows.join(common.small_or_not(terms, ROW_BYTES), "term", "left_semi")
    return rows.groupBy("term", "text_key").agg(F.collect_set("pos").alias("positions"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of terms occurs in docs; added up in each task before the shuffle."""
    rows = docs.select(F.explode(words(F.col("text"))).alias("term")).join(common.small_or_not(terms, ROW_BYTES), "term", "left_semi")
    return rows.groupBy("term").agg(F.count("*").alias("n"))


def items_of(bench: DataFrame, window: int) -> DataFrame:
    """item_id, item_key, item_words, len: the window's length, the item's own if that is shorter. Items without words are
    out; a repeated item is one row. item_key tells rows apart that repeat an item_id with another text."""
    items = bench.select("item_id", words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct()
    return items.withColumn("item_key", F.xxhash64("item_id", "item_words")).withColumn("len", F.least(F.size("item_words"), F.lit(window)))


def rarest_terms(items: DataFrame, counts: DataFrame) -> DataFrame:
    """item_key, term, item_pos, need: for each window of each item the places of its two rarest terms (one if it has a
    single word), and how many those are. A window with a term that docs don't have cannot occur and is left out."""
    at = items.select("item_key", "len", F.size("item_words").alias("m"), F.posexplode("item_words").alias("item_pos", "term"))
    at = at.join(counts, "term", "left")
    first, last = F.greatest(F.lit(0), F.col("item_pos") - F.col("len") + 1), F.least(F.col("item_pos"), F.col("m") - F.col("len"))
    inside = at.select("item_key", "term", "item_pos", F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.sequence(first, last)).alias("start"))
    best = inside.groupBy("item_key", "start").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "item_pos", "term"))), 1, 2).alias("best")).where("best[0].n > 0")
    return best.select("item_key", F.size("best").alias("need"), F.explode("best").alias("b")).select("item_key", "b.term", "b.item_pos", "need").distinct()


def alignments(index: DataFrame, pivots: DataFrame) -> DataFrame:
    """text_key, item_key, shift: where the offset-adjusted lists of an item's rarest terms intersect, so that
    item word i may be document word shift + i. As many rare places must agree as a window has; all of an item's windows
    have equally many."""
    pairs = index.join(common.small_or_not(pivots, ROW_BYTES), "term")
    pairs = pairs.select("text_key", "item_key", "need", "item_pos", F.explode("positions").alias("pos"))
    met = pairs.groupBy("text_key", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift"), "need").agg(F.count("*").alias("met"))
    return met.where("met >= need").select("text_key", "item_key", "shift")


def phrase_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """text_key, item_key, shift: candidate alignments of items in docs, each with the item's id, words and len."""
    items = common.materialize(items_of(bench, window), "bench-items")
    vocabulary = common.materialize(items.select(F.explode("item_words").alias("term")).distinct(), "bench-terms")
    counts = common.materialize(term_counts(docs, vocabulary), "bench-counts")
    pivots = common.materialize(rarest_terms(items, counts), "bench-pivots")
    index = common.materialize(postings(docs, pivots.select("term").distinct()), "bench-postings")
    found = alignments(index, pivots)
    return found.join(common.small_or_not(items, 16 * ROW_BYTES), "item_key")


def proximity_matches(index: DataFrame, query: list[str], slop: int) -> DataFrame:
    """text_key, pos: places of the query's first term, rarest first by the caller's choice, around which every
    other term occurs no more than slop words away. index: from postings(). Lists are intersected document by document,
    starting with the first term's; a repeated term counts once."""
    terms = list(dict.fromkeys(query))
    lists = index.where(F.col("term").isin(terms)).groupBy("text_key").agg(*(F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("positions")))).alias(f"p{i}") for i, t in enumerate(terms)))
    near = "p0"
    for i in range(1, len(terms)):
        near = f"filter({near}, p -> exists(p{i}, q -> abs(p - q) <= {int(slop)}))"
    return lists.select("text_key", F.explode(F.expr(f"array_sort({near})")).alias("pos"))


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """text_key, hit_words (sorted positions), item_list (sorted strings) of the texts with an occurrence.

    The texts with a candidate alignment are fetched by their keys, which are broadcast only if counted to be few, and the
    alignments are checked word by word there. A text's row holds its words and its alignments; of these there are no more
    than its words for each item that has a rarest term of its."""
    found = common.materialize(phrase_matches(docs, bench, window), "bench-alignments")
    keys = common.small_or_not(common.materialize(found.select("text_key").distinct(), "bench-ids"), 32)
    texts = docs.select(text_key().alias("text_key"), "text").join(keys, "text_key", "left_semi").dropDuplicates(["text_key"]).select("text_key", words(F.col("text")).alias("words"))
    spots = found.groupBy("text_key", "item_id", "item_words", "len").agg(F.collect_list("shift").alias("shifts"))
    spots = spots.groupBy("text_key").agg(F.collect_list(F.struct("item_id", "shifts", "item_words", "len")).alias("spots"))
    # a table, so that the words are cut once and not for each comparison
    both = common.materialize(texts.join(spots, "text_key"), "bench-words")
    runs = """filter(flatten(transform(spots, c -> transform(c.shifts, h -> struct(c.item_id, h as shift, c.len,
      filter(sequence(0, size(c.item_words) - c.len), s -> forall(sequence(s, s + c.len - 1), i -> coalesce(get(words, h + i) = c.item_words[i], false))) as starts)))), c -> size(c.starts) > 0)"""
    both = common.materialize(both.select("text_key", F.expr(runs).alias("runs")).where("size(runs) > 0"), "bench-runs")
    places = "array_sort(array_distinct(flatten(transform(runs, c -> flatten(transform(c.starts, s -> sequence(c.shift + s, c.shift + s + c.len - 1)))))))"
    return both.select("text_key", F.expr(places).alias("hit_words"), F.expr("array_sort(array_distinct(transform(runs, c -> coalesce(cast(c.item_id as string), ''))))").alias("item_list"))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that have an occurrence of a window of the benchmark, all columns kept.

    A window is that many consecutive words of an item; an item of fewer is one window. Null and empty texts have no
    words; items without words never match; repeated items and rows are treated alike, and so are null ids; a null item_id
    is listed as an empty string; of terms that are equally rare the first in the item is taken; very long texts are cut
    into words whole; an empty benchmark takes nothing, an empty table gives none."""
    gone = hits(docs, bench, window).select(F.col("text_key").alias("__key"))
    gone = common.small_or_not(common.materialize(gone, "bench-hits"), 32)
    return docs.join(gone, text_key(docs["text"]) == F.col("__key"), "left_anti")


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_list, hit_words, contaminated of every document; see decontaminate(). Only
    keys and counts are joined, no texts."""
    found = hits(docs, bench, window).select(F.col("text_key").alias("__key"), "hit_words", "item_list")
    found = common.materialize(found, "bench-hits")
    counted = docs.select("doc_id", text_key().alias("text_key"), n_words("text").alias("n_words"))
    out = counted.join(common.small_or_not(found, 64 * ROW_BYTES), F.col("text_key") == F.col("__key"), "left")
    out = out.withColumn("hit_words", F.coalesce("hit_words", F.array().cast("array<int>"))).withColumn("item_list", F.coalesce("item_list", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("item_list").cast("long").alias("n_items"), "item_list", "hit_words", (F.size("hit_words") > 0).alias("contaminated"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_list", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES = {
    "op5_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win FROM b, LATERAL unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(s) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM bw), LATERAL unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(s)
), hit AS (
  SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, LATERAL unnest(range(s, s + n)) AS u(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
