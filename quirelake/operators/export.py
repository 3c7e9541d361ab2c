"""Exports: pages, tokens, labelled spans, edges, annotated HTML, citations, tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Page layout in points: size, margins, advance of a character, line height.
WIDTH, HEIGHT, MARGIN, ADVANCE, LINE = 612.0, 792.0, 72.0, 6.0, 12.0
#: Characters of a page of that size.
PAGE_CHARS = 2500
#: What parts words; and words that are laid out before they are handed on.
BLANK, LAID = re.compile(r"[ \t\r\n]+"), 100_000


def page_count(n_chars, area_ratio: float = 1.0):
    """Estimated pages of a section, one at least."""
    return F.greatest(F.lit(1), F.ceil(n_chars / max(500, int(PAGE_CHARS * area_ratio)))).cast("long")


def token_layout(blocks: DataFrame, key: list[str]) -> DataFrame:
    """key, nth, token, x, y of a block's words: they advance by their length plus a space and wrap at the right margin;
    every block begins at the top left. Blocks go in Arrow batches, and each word is placed once."""
    right = WIDTH - MARGIN

    def run(batches):
        for batch in batches:
            keys = batch.select(key)
            for at, columns in placed(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([*keys.take(at).columns, *columns], names=[*key, "nth", "token", "x", "y"])

    def placed(texts):
        at, nth, tokens, xs, ys = [], [], [], [], []
        for k, text in enumerate(texts):
            x = y = MARGIN
            words = [w for w in BLANK.split(text or "") if w]
            for w in words:
                wide = len(w) * ADVANCE
                if x + wide > right and x > MARGIN:
                    x, y = MARGIN, y + LINE
                xs.append(x)
                ys.append(y)
                x += wide + ADVANCE
            at += [k] * len(words)
            nth += range(len(words))
            tokens += words
            if len(at) >= LAID or k == len(texts) - 1:
                yield pa.array(at, pa.int64()), [pa.array(nth, pa.int64()), pa.array(tokens, pa.string()), pa.array(xs, pa.float64()), pa.array(ys, pa.float64())]
                at, nth, tokens, xs, ys = [], [], [], [], []

    kinds = dict(blocks.dtypes)
    return blocks.select(*key, "text").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", nth long, token string, x double, y double")


def structural_edges(blocks: DataFrame, key: str, is_section) -> DataFrame:
    """CONTAINS edges from sections to the blocks up to the next one: key, edge, parent, child. Section ids are numbered
    from 0, block ids run on through the document."""
    w = W.partitionBy(key).orderBy("ord")
    b = blocks.withColumn("s", F.sum(is_section.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("s > 0")
    kids = b.where(~is_section).withColumn("child", F.concat(F.lit("para-"), (F.row_number().over(w) - 1).cast("string")))
    kids = kids.withColumn("edge", F.concat(F.lit("rel-"), (F.row_number().over(w) - 1).cast("string")))
    return kids.select(key, "edge", F.concat(F.lit("section-"), (F.col("s") - 1).cast("string")).alias("parent"), "child")


def validate(annotations: DataFrame, docs: DataFrame, labels: list[str]) -> DataFrame:
    """The first problem of each annotation (doc_id, ann, label, start, end, text, doc_hash): HashMismatch, MissingLabel
    (if labels are defined), OutOfBounds, TextMismatch, or null."""
    d = docs.select("doc_id", F.col("text").alias("content"), F.sha2("text", 256).alias("now"))
    a = annotations.join(d, "doc_id")
    bad = F.when(F.lower("doc_hash") != F.col("now"), "HashMismatch").when(F.lit(bool(labels)) & ~F.col("label").isin(labels), "MissingLabel")
    bad = bad.when((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.length("content")), "OutOfBounds")
    bad = bad.when(F.substr("content", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"), "TextMismatch")
    return a.select("doc_id", "ann", bad.alias("issue"))


def project(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, html: texts cut at all span ends (doc_id, label, start, end), each piece wrapped by the labels over it, in
    label order; & and < are escaped."""
    cuts = spans.select("doc_id", F.explode(F.array("start", "end")).alias("cut")).unionByName(docs.select("doc_id", F.explode(F.array(F.lit(0), F.length("text"))).alias("cut"))).distinct()
    pieces = cuts.withColumn("to", F.lead("cut").over(W.partitionBy("doc_id").orderBy("cut"))).where("to is not null")
    over = pieces.join(spans, "doc_id").where((F.col("start") <= F.col("cut")) & (F.col("end") >= F.col("to"))).groupBy("doc_id", "cut").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    p = pieces.join(over, ["doc_id", "cut"], "left").join(docs.select("doc_id", "text"), "doc_id")
    t = F.replace(F.replace(F.substr("text", F.col("cut") + 1, F.col("to") - F.col("cut")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.when(F.col("labels").isNull(), t).otherwise(F.concat(F.lit('<span class="'), F.array_join("labels", " "), F.lit('">'), t, F.lit("</span>")))
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cut", body.alias("b")))), lambda x: x["b"]), "").alias("html"))


def cite(asked: DataFrame, pages: DataFrame, version, fingerprint: str) -> DataFrame:
    """key, status, first_page, last_page: a citation needs a page map of the same version and renderer that has the
    anchor; else the reason. pages: key, anchor, map_version, renderer, page."""
    m = pages.groupBy("anchor").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.first("map_version").alias("map_version"), F.first("renderer").alias("renderer"))
    out = asked.join(m, "anchor", "left")
    status = F.when(F.col("map_version").isNull(), "noPageMap").when(F.col("map_version") != version, "staleVersion").when(F.col("renderer") != fingerprint, "otherRenderer").otherwise("available")
    return out.select("anchor", status.alias("status"), F.when(status == "available", F.col("first_page")).alias("first_page"), F.when(status == "available", F.col("last_page")).alias("last_page"))


def html_table(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """key, html: the rows of each key as an HTML table."""
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), esc(c), F.lit("</td>")) for c in columns), F.lit("</tr>"))
    return df.groupBy(*key).agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("html_row")))), lambda x: x["html_row"]), ""), F.lit("</table>")).alias("html"))


def gfm_table(df: DataFrame, key: list[str], order: list[str], columns: list[str], cell_max: int = 80) -> DataFrame:
    """key, mode (gfm or opaque), markdown: a Markdown table if no cell is longer than cell_max or has line ends."""
    cell = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    fits = F.lit(True)
    for c in cell:
        fits = fits & (F.length(c) <= cell_max) & ~F.contains(c, F.lit("\n"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(c, F.lit("|"), F.lit("\\|")) for c in cell)), F.lit(" |"))
    g = df.groupBy(*key).agg(F.bool_and(fits).alias("fits"), F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("r")))), lambda x: x["r"]).alias("rows"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return g.select(*key, F.when(F.col("fits"), "gfm").otherwise("opaque").alias("mode"), F.when(F.col("fits"), F.concat(F.lit(head), F.array_join("rows", "\n"))).otherwise(F.lit("[table]")).alias("markdown"))
