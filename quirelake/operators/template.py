"""Template assembly: content, repeats, conditionals and tables over nested data, with inline errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content(selected, optional: bool = False, path: str = ""):
    """A scalar of a selection (an array of strings): (text, error). None is an error unless optional; more than one
    always is. A value's lines become runs joined by a break mark."""
    n = F.coalesce(F.size(selected), F.lit(0))
    error = F.when(n > 1, F.lit(f"{path}: more than one node")).when((n < 1) & F.lit(not optional), F.lit(f"{path}: nothing selected"))
    text = F.when(n == 1, F.replace(selected[0], F.lit("\n"), F.lit("<br/>"))).when(n < 1, F.lit(""))
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), error.alias("error"))


def condition(selected, match: str | None = None, not_match: str | None = None):
    """Whether a Conditional keeps its body: the selection equals match, or differs from not_match."""
    value = F.coalesce(selected, F.lit(""))
    return value == match if match is not None else value != not_match


def repeat(data: DataFrame, key: list[str], array: str, optional: bool = False) -> DataFrame:
    """One row per member of an array column (item, at); an empty one gives a single row with an error unless optional."""
    some = data.select(*key, F.posexplode(array).alias("at", "item"), F.lit(None).cast("string").alias("error"))
    if optional:
        return some
    none = data.where(F.coalesce(F.size(array), F.lit(0)) < 1).select(*key, F.lit(0).alias("at"), F.lit(None).cast(dict(some.dtypes)["item"]).alias("item"), F.lit(f"{array}: nothing selected").alias("error"))
    return some.unionByName(none)


def table(data: DataFrame, key: list[str], array: str, cells: dict, footer) -> DataFrame:
    """Rows of a table made from a prototype row: key, line, text (cells joined by a bar), error; then one footer row.
    An empty selection is always an error."""
    rows = repeat(data, key, array)
    text = F.array_join(F.array(*(f(F.col("item")) for f in cells.values())), " | ")
    out = rows.select(*key, (F.col("at") + 1).alias("line"), F.when(F.col("error").isNull(), text).otherwise(F.lit("")).alias("text"), "error")
    foot = data.select(*key, (F.greatest(F.coalesce(F.size(array), F.lit(0)), F.lit(1)) + 1).alias("line"), footer.alias("text"), F.lit(None).cast("string").alias("error"))
    return out.unionByName(foot)
