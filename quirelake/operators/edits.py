"""Edits of block tables as keyed set operations: text, structure, tables, spans, notes, comments, controls, images.

Each operation takes a table of requests, so many documents are edited at once; every request comes back with success or
an error code, and the edited table follows from the successful ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def check(requests: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """requests (key, ord, and optional expected_hash, expected_text, expected_version) with error: the first guard that
    fails - AnchorNotFound, VersionMismatch, HashMismatch, TextMismatch - or null. A null expectation is not checked."""
    b = blocks.select(key, "ord", F.col("hash").alias("__hash"), F.col("text").alias("__text"), *(["version"] if "version" in blocks.columns else []))
    out = requests.join(b, [key, "ord"], "left")
    error = F.when(F.col("__hash").isNull(), "AnchorNotFound")
    if "expected_version" in requests.columns and "version" in blocks.columns:
        error = error.when(F.col("expected_version") != F.col("version"), "VersionMismatch")
    if "expected_hash" in requests.columns:
        error = error.when(F.col("expected_hash") != F.col("__hash"), "HashMismatch")
    if "expected_text" in requests.columns:
        error = error.when(F.col("expected_text") != F.col("__text"), "TextMismatch")
    return out.select(*requests.columns, error.alias("error"))


def renumber(blocks: DataFrame, place: str, key: str = "doc_id") -> DataFrame:
    """Blocks with ord counted anew in the order of a fractional place."""
    n = (F.row_number().over(W.partitionBy(key).orderBy(place)) - 1).cast("long")
    return blocks.select(key, n.alias("ord"), "text", F.sha2("text", 256).alias("hash"))


def replace_span(blocks: DataFrame, requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlay [start, end) of blocks with a text; a request outside the block, or a second one for it, does nothing."""
    one = requests.groupBy(key, "ord").agg(F.min(F.struct("start", "end", "new_text")).alias("r"))
    b = blocks.join(one, [key, "ord"], "left")
    fits = (F.col("r.start") >= 0) & (F.col("r.end") >= F.col("r.start")) & (F.col("r.end") <= F.length("text"))
    new = F.concat(F.substr("text", F.lit(1), F.col("r.start")), F.col("r.new_text"), F.substr("text", F.col("r.end") + 1))
    return b.select(key, "ord", F.when(fits, new).otherwise(F.col("text")).alias("text")).withColumn("hash", F.sha2("text", 256))


def delete_blocks(blocks: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return renumber(blocks.join(gone.select(key, "ord"), [key, "ord"], "left_anti").withColumn("__place", F.col("ord")), "__place", key)


def delete_ranges(blocks: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Delete blocks from first to last, both included; one range for each document."""
    b = blocks.join(ranges.select(key, "first", "last"), key, "left")
    return renumber(b.where(F.col("first").isNull() | (F.col("ord") < F.col("first")) | (F.col("ord") > F.col("last"))).withColumn("__place", F.col("ord")), "__place", key)


def insert_blocks(blocks: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Insert texts after a block (after = -1: in front); several after one block keep the order of seq."""
    n = new.select(key, (F.col("after") + 0.5).alias("__place"), F.col("seq").alias("__seq"), "text")
    both = blocks.select(key, F.col("ord").cast("double").alias("__place"), F.lit(0).cast("long").alias("__seq"), "text").unionByName(n.withColumn("__seq", F.col("__seq").cast("long")))
    return renumber(both.withColumn("__at", F.struct("__place", "__seq")), "__at", key)


def move_blocks(blocks: DataFrame, moves: DataFrame, key: str = "doc_id") -> DataFrame:
    """Move a block to behind another one (after = -1: to the front); one move for each document."""
    b = blocks.join(moves.select(key, F.col("ord").alias("__from"), "after"), key, "left")
    place = F.when(F.col("ord") == F.col("__from"), F.col("after") + 0.5).otherwise(F.col("ord").cast("double"))
    return renumber(b.withColumn("__place", place), "__place", key)


def split_blocks(blocks: DataFrame, at: DataFrame, key: str = "doc_id") -> DataFrame:
    """Split blocks at a character offset (key, ord, offset)."""
    b = blocks.join(at.select(key, "ord", "offset"), [key, "ord"], "left")
    inside = (F.col("offset") > 0) & (F.col("offset") < F.length("text"))
    parts = F.when(inside, F.array(F.substr("text", F.lit(1), F.col("offset")), F.substr("text", F.col("offset") + 1))).otherwise(F.array("text"))
    return renumber(b.select(key, "ord", F.posexplode(parts).alias("__part", "text")).withColumn("__at", F.struct("ord", "__part")), "__at", key)


def merge_blocks(blocks: DataFrame, firsts: DataFrame, separator: str = " ", key: str = "doc_id") -> DataFrame:
    """Merge each named block with the one behind it."""
    b = blocks.join(firsts.select(key, "ord", F.lit(1).alias("__first")), [key, "ord"], "left")
    w = W.partitionBy(key).orderBy("ord")
    b = b.withColumn("__joined", F.coalesce(F.lag("__first").over(w), F.lit(0)))
    b = b.withColumn("__group", F.sum(F.when(F.col("__joined") == 1, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return renumber(b.groupBy(key, "__group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), separator).alias("text")), "__group", key)


# Tables -----------------------------------------------------------------------------------------------------------------


def insert_row(cells: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    """Insert an empty row before a row of each table (keys, at); cells: keys, row, col, text."""
    c = cells.join(at, keys, "left")
    moved = c.select(*keys, F.when(F.col("row") >= F.col("at"), F.col("row") + 1).otherwise(F.col("row")).alias("row"), "col", "text")
    new = c.where("at is not null").select(*keys, F.col("at").alias("row"), "col", F.lit("").alias("text")).distinct()
    return moved.unionByName(new)


def delete_column(cells: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    c = cells.join(at, keys, "left")
    return c.where(F.col("at").isNull() | (F.col("col") != F.col("at"))).select(*keys, "row", F.when(F.col("col") > F.col("at"), F.col("col") - 1).otherwise(F.col("col")).alias("col"), "text")


def merge_cells(cells: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Merge a box of cells (keys, top, left, bottom, right) into its first: texts joined by a line end in reading order,
    with row_span and col_span."""
    c = cells.join(boxes, keys, "left")
    inside = F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right"))
    c = c.withColumn("__in", F.coalesce(inside, F.lit(False)))
    c = c.withColumn("__row", F.when(F.col("__in"), F.col("top")).otherwise(F.col("row"))).withColumn("__col", F.when(F.col("__in"), F.col("left")).otherwise(F.col("col")))
    g = c.groupBy(*keys, "__row", "__col").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda x: x["text"]), lambda t: t != ""), "\n").alias("text"), F.countDistinct("row").alias("row_span"), F.countDistinct("col").alias("col_span"))
    return g.withColumnsRenamed({"__row": "row", "__col": "col"})


# Spans, notes, controls, images -----------------------------------------------------------------------------------------


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of table after changes (the columns of table, order, and op: put or remove); the last change of a key wins.
    The way of annotations, comments, hyperlinks, bookmarks, images and headers."""
    last = changes.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__n = 1")
    kept = table.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.where("op = 'put'").select(*table.columns))


def fill_controls(controls: DataFrame, fills: DataFrame, keys: list[str]) -> DataFrame:
    """Content controls (keys, kind, value, locked, items) with new values where the guards allow: outcome is filled,
    locked, notAnItem (a drop-down without that item), badDate, badCheckbox or untouched."""
    c = controls.join(fills.select(*keys, F.col("value").alias("__new")), keys, "left")
    outcome = F.when(F.col("__new").isNull(), "untouched").when(F.col("locked"), "locked").when((F.col("kind") == "dropdown") & ~F.array_contains("items", F.col("__new")), "notAnItem")
    outcome = outcome.when((F.col("kind") == "date") & F.col("__new").try_cast("date").isNull(), "badDate").when((F.col("kind") == "checkbox") & ~F.col("__new").isin("true", "false"), "badCheckbox").otherwise("filled")
    return c.withColumn("outcome", outcome).withColumn("value", F.when(F.col("outcome") == "filled", F.col("__new")).otherwise(F.col("value"))).drop("__new")


def scale_image(width, height, new_width=None, new_height=None):
    """Width and height in EMU after setting one of them, the ratio kept, or both."""
    w = new_width if new_width is not None else F.round(width * new_height / height)
    h = new_height if new_height is not None else F.round(height * new_width / width)
    return F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))


def bookmarks_over(bookmarks: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """name and covered blocks of bookmarks (key, name, first, last)."""
    return bookmarks.join(blocks.select(key, "ord"), key).where(F.col("ord").between(F.col("first"), F.col("last"))).groupBy(key, "name").agg(F.array_sort(F.collect_list("ord")).alias("ords"))
