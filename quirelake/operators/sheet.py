"""Sheets and tables: ranges, headers, pivots, cache facts, metrics, table grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quirelake.functions import numbers as N


def parse_range(text: str) -> tuple[int, int, int, int]:
    """"A1:B9" as left, top, right, bottom; a single address is a range of one cell."""
    def split(a: str) -> tuple[int, int]:
        letters = a.rstrip("0123456789")
        n = 0
        for c in letters.upper():
            n = n * 26 + ord(c) - 64
        return n, int(a[len(letters):])

    a, _, b = text.replace("$", "").partition(":")
    left, top = split(a)
    right, bottom = split(b or a)
    return min(left, right), min(top, bottom), max(left, right), max(top, bottom)


def scan_range(cells: DataFrame, text: str) -> DataFrame:
    """Cells inside a range, both ends included."""
    left, top, right, bottom = parse_range(text)
    return cells.where(F.col("row").between(top, bottom) & F.col("col").between(left, right))


def typed(cells: DataFrame) -> DataFrame:
    """Cells with number, boolean and text by kind; what doesn't parse is null."""
    return cells.select("*", F.when(F.col("kind").isin("bigint", "int", "double", "decimal"), F.col("value").try_cast("double")).alias("number"), F.when(F.col("kind") == "boolean", F.col("value").try_cast("boolean")).alias("flag"), F.when(F.col("kind") == "string", F.col("value")).alias("text"))


def by_header(cells: DataFrame, names: list[str]) -> DataFrame:
    """Sheet rows as a table: one column per header name, in sheet order."""
    return cells.groupBy("row").agg(*(F.max(F.when(F.col("col") == i, F.col("value"))).alias(n) for i, n in enumerate(names, 1)))


def repaired(cells: DataFrame) -> DataFrame:
    """Columns of cells without one, from the nearest known neighbour to the left in the row (else to the right), by the
    distance in cells. cells: row, pos (order in the row), col (null if unknown)."""
    w = W.partitionBy("row").orderBy("pos")
    left = F.last(F.when(F.col("col").isNotNull(), F.col("col") - F.col("pos")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    right = F.first(F.when(F.col("col").isNotNull(), F.col("col") - F.col("pos")), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return cells.withColumn("col", F.coalesce("col", left + F.col("pos"), right + F.col("pos"), F.col("pos")))


def pivot(df: DataFrame, rows: list[str], column: str, values: list, data: dict[str, str]) -> DataFrame:
    """A pivot table: row axes, one column per value of the column axis and data field; data: field -> aggregate."""
    aggs = [getattr(F, how)(F.when(F.col(column) == v, F.col(field))).alias(f"{v}_{how}_{field}") for v in values for field, how in data.items()]
    return df.groupBy(*rows).agg(*aggs)


def cache_facts(df: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """field, least, most, all_integer, n_items, items (distinct in first-seen order, as one digestible string)."""
    long = df.select(order, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("item"), F.col(f).try_cast("double").alias("x")) for f in fields))).alias("c")).select(order, "c.*")
    one = long.groupBy("field", "item").agg(F.min(order).alias("first"), F.first("x").alias("x"))
    return one.groupBy("field").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.bool_and((F.col("x") == F.floor("x"))).alias("all_integer"), F.count("*").alias("n_items"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "item"))), lambda s: s["item"]), "|"), 256).alias("items_hash"))


def grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, row, pos, span, v_merge: restart, continue or null) with grid_start and the row that covers each cell
    (its vertical merge's first row). A table's cells are one row, and tables go in Arrow batches, so that a task sorts
    cells once."""
    others = [c for c in cells.columns if c not in keys]

    def run(batches):
        for batch in batches:
            lists = batch.column("cells")
            table = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            rows = dict(zip(others, lists.flatten().flatten(), strict=True))
            start, covering = placed_cells(table, *(pc.fill_null(rows[c].cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for c in ("row", "pos", "span")), rows["v_merge"])
            yield pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(table)).columns, *rows.values(), pa.array(start), pa.array(covering)], names=[*keys, *others, "grid_start", "covering_row"])

    tables = cells.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("cells"))
    none = F.lit(None).cast("long")
    return tables.mapInArrow(run, cells.select(*keys, *others, none.alias("grid_start"), none.alias("covering_row")).schema)


def placed_cells(table: np.ndarray, row: np.ndarray, pos: np.ndarray, span: np.ndarray, v_merge: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """grid_start and covering row of each cell, see grid; table numbers the tables."""
    start, covering, n = np.zeros(len(row), np.int64), row.copy(), len(row)
    if not n:
        return start, covering
    heads = lambda *columns: np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
    first = lambda new: np.maximum.accumulate(np.where(new, np.arange(n), 0))
    order = np.lexsort((pos, row, table))
    ahead = np.cumsum(span[order]) - span[order]
    start[order] = ahead - ahead[first(heads(table[order], row[order]))]
    goes_on = pc.fill_null(pc.equal(v_merge, "continue"), False).to_numpy(zero_copy_only=False)
    begins = pc.or_(pc.is_null(v_merge), pc.fill_null(pc.equal(v_merge, "restart"), False)).to_numpy(zero_copy_only=False)
    order = np.lexsort((row, start, table))
    new = first(heads(table[order], start[order]))
    last = np.maximum.accumulate(np.where(begins[order], np.arange(n), -1))  # of this column, if not before its first cell
    covering[order] = np.where(goes_on[order] & (last >= new), row[order][np.maximum(last, 0)], row[order])
    return start, covering


def address(row, col):
    return F.concat(N.column_letters(col), row.cast("string"))
