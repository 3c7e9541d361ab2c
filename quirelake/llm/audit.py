"""Filter interaction audit: what each of five filters removes in every order they may be applied in.

Joint failures of all 32 sets of filters are counted in one aggregation, as products of flags. Everything else follows
from these counts by inclusion and exclusion: survivors, unique failures, redundancy, and the Shapley value from Harsanyi
dividends."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import common

#: The filters' names; the n-th one is bit n of a set of filters.
FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
ORDERS = factorial(len(FILTERS))
SPACE = "[\\x20\\x09-\\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
#: What is counted: all documents, the good ones, the toxic ones.
KINDS = ("every", "good", "toxic")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (1: the filter fails the document), good and toxic, one row for each row of docs.

    A null text is empty, a null lang the part ''. A document is good or toxic if any of its labels says so; one without an id has none. E compares
    texts by SHA-256: a row fails it if a smaller doc_id has its text. A null doc_id is neither smaller nor larger than
    another; rows that repeat the smallest one of a text all pass. The hash's smallest id comes from an aggregation and is
    looked up by hash and id together, so a text that a third of all rows have is dealt over all tasks."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    flags = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words.alias("words")).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"),
        (F.size("words") < MIN_WORDS).cast("long").alias("A"),
        (100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * F.size("words")).cast("long").alias("B"),
        (100 * (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))) > MAX_CAPITALS * F.length("text")).cast("long").alias("C"),
        F.col("text").rlike("[#$%&*|]").cast("long").alias("D"))
    flags = common.materialize(flags, "filter-flags")
    firsts = flags.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(1))
    marks = labels.groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("long")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    known = flags.where("doc_id is not null").join(firsts, ["text_key", "doc_id"], "left").join(marks, "doc_id", "left")
    known = known.withColumn("E", F.col("first").isNull().cast("long"))
    unknown = flags.where("doc_id is null").withColumns({"E": F.lit(0).cast("long"), "good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    columns = ["part", *FILTERS, *[F.coalesce(k, F.lit(0)).alias(k) for k in KINDS[1:]]]
    return known.select(*columns).unionByName(unknown.select(*columns))


def joint_failures(flags: DataFrame, by: str = "part") -> DataFrame:
    """by, and for each of KINDS an array whose member s counts the documents that fail every filter of the set s."""
    sums = flags.groupBy(by).agg(*[F.expr(f"sum({' * '.join([k] * (k != 'every') + [f for i, f in enumerate(FILTERS) if s >> i & 1] or ['1L'])}) as {k}_{s}") for k in KINDS for s in SETS])
    return sums.select(by, *[F.array(*[F.col(f"{k}_{s}") for s in SETS]).alias(k) for k in KINDS])


def survivors(joint: str):
    """Member s: the documents that pass every filter of s, the sum of (-1)^|t| joint[t] over the subsets t of s."""
    return F.expr(f"array({', '.join(_signed(joint, 0, [t for t in SETS if t & s == t]) for s in SETS)})")


def exactly(joint: str):
    """Member s: the documents that fail the filters of s and no other, the Möbius inversion of joint over supersets."""
    return F.expr(f"array({', '.join(_signed(joint, s, [t for t in SETS if t & s == s]) for s in SETS)})")


def _signed(joint: str, s: int, sets: list[int]) -> str:
    """The sum of joint over the sets, with a minus where a set's size and that of s differ by an odd number."""
    return " ".join(f"{'-' if (s ^ t).bit_count() % 2 else '+'} {joint}[{t}]" for t in sets)


def shapley(joint: str):
    """Member i: the i-th filter's removals summed over all orders. The game "documents that the set removes" has the
    dividend (-1)^(|t|+1) joint[t] at t, which the members of t share evenly; the number of orders over |t| is whole."""
    share = lambda t: f"{'+' if t.bit_count() % 2 else '-'} {ORDERS // t.bit_count()} * {joint}[{t}]"
    return F.expr(f"array({', '.join(' '.join(share(t) for t in SETS if t >> i & 1) for i in range(len(FILTERS)))})")


def effects(joint: DataFrame, by: str = "part") -> DataFrame:
    """A row for each group, order of the filters and step; see op12_filter_audit for its columns."""
    sums = joint.select(by, F.col("every").alias("fails"), *[survivors(k).alias(f"{k}_left") for k in KINDS], exactly("every").alias("exact"), shapley("every").alias("shapley"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = sums.withColumn("filter_order", F.explode(orders)).withColumn("letters", F.split("filter_order", "")).select("*", F.posexplode("letters").alias("at", "letter"))
    bit = lambda letter: F.expr(f"shiftleft(1, ascii({letter}) - {ord(FILTERS[0])})")
    before = F.expr(f"aggregate(slice(letters, 1, at), 0, (a, x) -> a + shiftleft(1, ascii(x) - {ord(FILTERS[0])}))")
    steps = steps.withColumns({"bit": bit("letter"), "before": before}).withColumn("after", F.col("before") + F.col("bit"))
    lost = lambda k: F.get(f"{k}_left", F.col("before")) - F.get(f"{k}_left", F.col("after"))
    return steps.select(
        by, "filter_order", (F.col("at") + 1).cast("int").alias("step"), F.get("every_left", F.col("after")).alias("kept"), lost("every").alias("removed"),
        (F.get("fails", F.col("bit")) - lost("every")).alias("redundant"), F.get("exact", F.col("bit")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.ascii("letter") - ord(FILTERS[0])).alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of all documents;
    an empty table has no parts and so no rows."""
    docs = common.table(spark, sf_dir, "documents")
    return effects(joint_failures(judged(docs, common.table(spark, sf_dir, "labels"))))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {
    "op12_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.toxic = 1) AS toxic
  FROM t
), p AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, i, 1) AS own, left(filter_order, i - 1) AS earlier FROM o, unnest(range(1, 6)) AS u(i)
), r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT early AND NOT fails_own), 0) AS kept, coalesce(sum(n) FILTER (NOT early AND fails_own), 0) AS removed,
    coalesce(sum(n) FILTER (early AND fails_own), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
    coalesce(sum(g) FILTER (NOT early AND fails_own), 0) AS good_lost, coalesce(sum(x) FILTER (NOT early AND fails_own), 0) AS toxic_lost
  FROM (SELECT p.*, s.*, contains(fails, own) AS fails_own, translate(fails, earlier, '') <> fails AS early FROM p, s) GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
""",
}
