"""Rules that a user gives as Python and that make rows: table functions over partitioned and ordered tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule:
    """A row-generating rule: start() makes the state of a group, step(state, row) gives rows for each of its rows in order,
    finish(state) rows at its end. State stays in the worker and is as large as the rule makes it, so a group of any size
    can go through; rows are tuples of the schema."""

    def __init__(self, schema: str, step: Callable[[dict, object], Iterable[tuple]], start: Callable[[], dict] = dict, finish: Callable[[dict], Iterable[tuple]] | None = None):
        class Function:
            def __init__(self):
                self.state = start()

            def eval(self, row):
                yield from step(self.state, row)

            def terminate(self):
                if finish:
                    yield from finish(self.state)

        self.function = F.udtf(Function, returnType=schema)

    def over(self, table: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        """What the rule makes of each group of a table. Rows of a group are dealt to one task and sorted there."""
        return self.function(table.asTable().partitionBy(*by).orderBy(*order))


def detected(tables: dict[str, DataFrame], detectors: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """detector, part, finding of detectors that are registered for kinds of parts: each gets its kind's table and returns
    part and finding. Kinds without a detector, and detectors without a table, are left out; no table is read twice."""
    out = None
    for kind, detector in detectors.items():
        if kind in tables:
            found = detector(tables[kind]).select(F.lit(kind).alias("detector"), F.col("part").cast("string").alias("part"), F.col("finding").cast("string").alias("finding"))
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no detector has a table")
    return out
