"""URL filters: rules by host and path, and for the other URLs the ratio of two character language models.

The models are variable-order Markov chains over code points: one learns from the URLs that a rule allows, the other from
those that a rule blocks. A context's estimate is smoothed by that of the context without its first character (Witten and
Bell), so each place is judged by the longest context that training has seen. A URL's score is the difference of its two
log-likelihoods over its length; the threshold is calibrated on labelled URLs held out of training.

DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.llm import common

#: The rules of the query: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Characters of the longest context.
ORDER = 4
#: Characters before and after a URL's own.
START, END = "\x02", "\x03"
#: Labelled URLs whose MD5 begins so, one in sixteen, are held out of training to calibrate the threshold.
HELD_OUT = "0"
#: At most so many n-grams are head: each has more than the HEAD-th part of all places. They are broadcast, the rest is
#: joined by shuffle, where no n-gram has more than that part of the rows.
HEAD = 100_000
#: Log-likelihoods are summed as whole numbers of 1e-9, so a sum doesn't depend on its order; buckets of scores are 0.01 wide.
SCALE, BUCKET = 1_000_000_000, 10_000_000


def parts(url):
    """host and path columns: the host after the first :// (A-Z lowered) up to / ? # or the end, the path from there up to
    ? # or the end; both empty for null and without ://."""
    found = lambda i: F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(found(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found(2)


def ruled(host, path, rules=RULES):
    """A struct of rule and verdict, null if no rule fits: the longest that has the host or a domain above it and begins the
    path; of two as long the first in order of letters. The list is part of the plan, so it is meant for some hundred rules."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def spelled(url, host):
    """What the models read: host (lowered), path, query and fragment; a URL without :// as it is, null as empty."""
    rest = F.regexp_extract(url, "(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.concat(host, rest)).otherwise(F.coalesce(url, F.lit("")))


def placed(rows: DataFrame, *columns: str, order: int = ORDER) -> DataFrame:
    """columns and gram: an n-gram of order + 1 characters for each character of text, and for its end. A text is cut into
    characters once and shifted copies of it are zipped, so time is in proportion to its length."""
    own = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", ""))
    chars = rows.select(*columns, F.concat(F.array_repeat(F.lit(START), order), own, F.array(F.lit(END))).alias("chars"), (F.length("text") + 1).alias("n_places"))
    shifted = [F.slice("chars", k + 1, F.col("n_places")).alias(f"c{k}") for k in range(order + 1)]
    return chars.select(*columns, F.explode(F.arrays_zip(*shifted)).alias("c")).select(*columns, F.concat(*[F.col(f"c.c{k}") for k in range(order + 1)]).alias("gram"))


def known_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """A stored row for each page_id and url: how many rows have them (n), host, path, rule and verdict by rule, the text
    for the models, n as training weight of either class, and whether the row is held out."""
    host, path = parts(F.col("url"))
    rows = pages.groupBy("page_id", "url").agg(F.count("*").alias("n")).withColumns({"host": host, "path": path}).withColumn("by", ruled(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "n", "host", "path", "by.rule", "by.verdict", spelled(F.col("url"), F.col("host")).alias("text"))
    held = F.col("rule").isNotNull() & F.md5("text").startswith(HELD_OUT)
    weight = lambda v: F.when((F.col("verdict") == v) & ~F.col("held"), F.col("n")).otherwise(0)
    return common.materialize(rows.withColumn("held", held).withColumns({"accepted": weight("allow"), "rejected": weight("block"), "url_key": F.xxhash64("url")}), "urls")


def model(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n, delta of every n-gram of order + 1 characters in the rows: its places, and the difference of its last
    character's two log-probabilities after the others, in units of 1 / SCALE.

    Counts of shorter n-grams are sums over the longer ones that end in them. A context's n-grams, and those that end alike,
    are no more than there are characters, so neither the windows nor the joins have hot keys."""
    full = placed(rows, "n", "accepted", "rejected", order=order).groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "accepted", "rejected")])
    levels = [common.materialize(full, "url-grams")]
    for _ in range(order):
        levels.insert(0, common.materialize(levels[0].groupBy(F.substring("gram", 2, order + 1).alias("gram")).agg(*[F.sum(c).alias(c) for c in ("n", "accepted", "rejected")]), "url-grams", narrow=True))
    lower = None
    for k, level in enumerate(levels):
        context = W.partitionBy(F.substring("gram", 1, k))
        level = level.withColumns({f"{c}_{x}": f.over(context) for c in ("accepted", "rejected") for x, f in (("all", F.sum(c)), ("kinds", F.sum((F.col(c) > 0).cast("long"))))})
        if lower is None:  # below single characters all are equally likely
            every = F.count("*").over(context)
            level = level.withColumns({"accepted_lower": 1.0 / every, "rejected_lower": 1.0 / every})
        else:
            level = level.withColumn("end", F.substring("gram", 2, order + 1)).join(lower, "end")
        smoothed = lambda c: F.when(F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_lower")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_lower"))
        lower = level.select(F.col("gram").alias("end"), "n", *[smoothed(c).alias(f"{c}_lower") for c in ("accepted", "rejected")])
        if k < order:
            lower = lower.drop("n")
    delta = F.round((F.ln("accepted_lower") - F.ln("rejected_lower")) * SCALE).cast("long")
    return common.materialize(lower.select(F.col("end").alias("gram"), "n", delta.alias("delta")), "url-model")


def scores(rows: DataFrame, grams: DataFrame, order: int = ORDER, head: int = HEAD) -> DataFrame:
    """page_id, url_key, ratio (the sum of its n-grams' deltas, a long) of each row."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    frequent = F.broadcast(grams.where(F.col("n") > total // head).select("gram", "delta"))
    cut = placed(rows, "page_id", "url_key", order=order).join(frequent, "gram", "left")
    cut = cut.groupBy("page_id", "url_key", F.when(F.col("delta").isNull(), F.col("gram")).alias("gram")).agg(F.sum("delta").alias("ratio"), F.count("*").alias("times"))
    cut = common.materialize(cut, "url-places")
    rare = cut.where("gram is not null").join(grams.where(F.col("n") <= total // head).select("gram", "delta"), "gram").select("page_id", "url_key", (F.col("delta") * F.col("times")).alias("ratio"))
    return cut.where("gram is null").select("page_id", "url_key", "ratio").unionByName(rare).groupBy("page_id", "url_key").agg(F.sum("ratio").alias("ratio"))


def calibrated(held: DataFrame) -> int:
    """The bucket from which on a URL is accepted: that with the greatest sum of the share of accepted held-out URLs that
    it accepts and the share of rejected ones that it rejects; ties: the nearest to 0, then the smaller. Between two buckets
    that have URLs all are as good, so that nearest to 0 stands for them. 0 if a class is missing. Buckets are as many as scores have hundredths, whatever the input."""
    hist = held.groupBy("bucket").agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")])
    below, every = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    under = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0))
    gain = (F.sum("allow").over(every) - under("allow")) / F.sum("allow").over(every) + under("block") / F.sum("block").over(every)
    cut = F.least("bucket", F.greatest(F.lag("bucket").over(W.orderBy("bucket")) + 1, F.lit(0)))
    classes = (F.sum("allow").over(every) > 0) & (F.sum("block").over(every) > 0)
    best = hist.select(cut.alias("cut"), F.when(classes, gain).alias("gain")).where("gain is not null").orderBy(F.desc("gain"), F.abs("cut"), "cut").first()
    return best["cut"] if best else 0


def url_filters(pages: DataFrame, rules=RULES, order: int = ORDER, head: int = HEAD) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row of pages (score is null where a rule decides).

    A null url, or one without ://, has an empty host and path; without a rule it is scored like any other text, the empty
    one by its end alone. Rows that repeat a page_id and url get the same verdict, once for each row. Without a labelled
    URL of a class its model is uniform and the threshold 0. Very long URLs take time in proportion; an empty table gives no
    rows; other columns of pages aren't read."""
    rows = known_urls(pages, rules)
    grams = model(rows, order)
    open_ = rows.where(F.col("rule").isNull() | F.col("held"))
    found = common.materialize(scores(open_, grams, order, head), "url-scores")
    judged = open_.join(found.withColumnsRenamed({"page_id": "__id", "url_key": "__key"}), F.col("page_id").eqNullSafe(F.col("__id")) & F.col("url_key").eqNullSafe(F.col("__key")))
    length = F.length("text").cast("long") + 1
    judged = judged.withColumns({"bucket": F.floor(F.col("ratio") / (length * BUCKET)), "score": F.col("ratio") / (length * SCALE)})
    least = calibrated(judged.where("held"))
    free = judged.where("rule is null").withColumn("verdict", F.when(F.col("bucket") >= least, "allow").otherwise("block"))
    columns = ["page_id", "host", "path", "rule", "verdict", "n"]
    out = rows.where("rule is not null").select(*columns, F.lit(None).cast("double").alias("score")).unionByName(free.select(*columns, "score"))
    # as many rows as there were, in arrays of bounded size
    many = F.expr("explode(sequence(0L, (n - 1) div 10000))").alias("block")
    out = out.select("*", many).select("*", F.expr("explode(sequence(1L, least(10000L, n - block * 10000)))").alias("copy"))
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(common.table(spark, sf_dir, "pages")).drop("score")


def _level_sql(k: int) -> str:
    """Order k of the SQL: sums of the longer n-grams, then Witten and Bell over the order below."""
    counts = f"SELECT substr(gram, 2) AS gram, sum(a) AS a, sum(r) AS r FROM g{k + 1} GROUP BY 1" if k < ORDER else "SELECT gram, sum(a) AS a, sum(r) AS r FROM cut GROUP BY 1"
    lower = ("1.0::DOUBLE / count(*) OVER () AS al, 1.0::DOUBLE / count(*) OVER () AS rl", "") if k == 0 else ("p.pa AS al, p.pr AS rl", f" JOIN p{k - 1} p ON p.gram = substr(g.gram, 2)")
    w = f"OVER (PARTITION BY left(g.gram, {k}))"
    est = lambda c: f"CASE WHEN {c}n > 0 THEN ({c} + {c}k * {c}l) / ({c}n + {c}k) ELSE {c}l END AS p{c}"
    return counts, f"SELECT gram, {est('a')}, {est('r')} FROM (SELECT g.gram, a::DOUBLE AS a, r::DOUBLE AS r, (sum(a) {w})::DOUBLE AS an, (sum(r) {w})::DOUBLE AS rn, (count(*) FILTER (a > 0) {w})::DOUBLE AS ak, (count(*) FILTER (r > 0) {w})::DOUBLE AS rk, {lower[0]} FROM g{k} g{lower[1]})"


def _sql() -> str:
    levels = [_level_sql(k) for k in range(ORDER + 1)]
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    by = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    grams = ", ".join(f"g{k} AS ({levels[k][0]})" for k in range(ORDER, -1, -1)) + ", " + ", ".join(f"p{k} AS ({levels[k][1]})" for k in range(ORDER + 1))
    return rf"""
WITH u AS (
  SELECT page_id, url, position('://' IN url) AS mark, substr(url, position('://' IN url) + 3) AS rest FROM pages
), v AS (
  SELECT *, CASE WHEN mark > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN mark > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u
), w AS (
  SELECT *, row_number() OVER () AS id, CASE WHEN mark > 0 THEN host || substr(rest, length(host) + 1) ELSE coalesce(url, '') END AS text,
    CASE {' '.join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in by)} END AS rule, CASE {' '.join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in by)} END AS label FROM v
), x AS (
  SELECT *, label IS NOT NULL AND starts_with(md5(text), '{HELD_OUT}') AS held FROM w
), cut AS (
  SELECT id, substr(padded, i, {ORDER + 1}) AS gram, CASE WHEN label = 'allow' AND NOT held THEN 1 ELSE 0 END AS a, CASE WHEN label = 'block' AND NOT held THEN 1 ELSE 0 END AS r
  FROM (SELECT *, repeat(chr({ord(START)}), {ORDER}) || text || chr({ord(END)}) AS padded FROM x), LATERAL unnest(range(1, length(text) + 2)) AS t(i)
), {grams}, s AS (
  SELECT id, CAST(sum(CAST(round((ln(pa) - ln(pr)) * {SCALE}) AS BIGINT)) AS BIGINT) AS ratio FROM cut JOIN p{ORDER} USING (gram) GROUP BY id
), j AS (
  SELECT x.*, CAST(floor(CAST(ratio AS DOUBLE) / CAST(CAST(length(text) + 1 AS BIGINT) * {BUCKET} AS DOUBLE)) AS BIGINT) AS bucket FROM x JOIN s USING (id)
), h AS (
  SELECT bucket, count(*) FILTER (label = 'allow') AS y, count(*) FILTER (label = 'block') AS n FROM j WHERE held GROUP BY 1
), c AS (
  SELECT least(bucket, greatest(lag(bucket) OVER (ORDER BY bucket) + 1, 0)) AS cut, (sum(y) OVER () - coalesce(sum(y) OVER b, 0)) / nullif(sum(y) OVER (), 0) + coalesce(sum(n) OVER b, 0) / nullif(sum(n) OVER (), 0) AS gain FROM h
  WINDOW b AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), least_ AS (SELECT coalesce((SELECT cut FROM c WHERE gain IS NOT NULL ORDER BY gain DESC, abs(cut), cut LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN bucket >= least THEN 'allow' ELSE 'block' END) AS verdict FROM j, least_
"""


QUERIES = {"op13_url_filters": op13_url_filters}
ORACLES = {"op13_url_filters": _sql()}
