"""Cascades: style chains by recursion, property merging, CSS rules and inheritance, list counters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def style_chain(styles: DataFrame, most: int = 50) -> DataFrame:
    """style, ancestor, depth (0: itself) over based_on links, nearest first. A cycle ends at the depth limit."""
    styles.select("style", "based_on").createOrReplaceTempView("quirelake_styles")
    return styles.sparkSession.sql(f"""WITH RECURSIVE chain(style, ancestor, depth) AS (
      SELECT style, style, 0L FROM quirelake_styles
      UNION ALL SELECT c.style, s.based_on, c.depth + 1 FROM chain c JOIN quirelake_styles s ON s.style = c.ancestor WHERE s.based_on IS NOT NULL AND c.depth < {most})
      SELECT style, ancestor, depth FROM chain""")


def effective(chain: DataFrame, properties: DataFrame, toggles: list[str]) -> DataFrame:
    """style, property, value: the nearest ancestor's value; a toggle is on if an odd number of ancestors set it true.
    properties: style, property, value (null: not set)."""
    p = properties.where("value is not null").select(F.col("style").alias("ancestor"), "property", "value")
    met = chain.join(p, "ancestor").groupBy("style", "property").agg(F.min_by("value", "depth").alias("nearest"), F.count_if(F.col("value") == "true").alias("on"))
    toggled = F.when(F.col("on") % 2 == 1, "true").otherwise("false")
    return met.select("style", "property", F.when(F.col("property").isin(toggles), toggled).otherwise(F.col("nearest")).alias("value"))


SHORTHANDS = ("margin", "padding")


def parse_css(text: str) -> list[tuple[str, int, int, str, str, bool]]:
    """(selector, specificity, sequence, property, value, important) of flat rules; comments are dropped, box shorthands
    expanded to their four sides. Selectors: lists of tag, .class, #id and their compounds."""
    out, seq = [], 0
    text = re.sub(r"(?s)/\*.*?\*/", "", text or "")
    for selectors, body in re.findall(r"([^{}]+)\{([^{}]*)\}", text):
        for selector in (s.strip() for s in selectors.split(",")):
            spec = 100 * selector.count("#") + 10 * selector.count(".") + (1 if re.match(r"[a-zA-Z]", selector) else 0)
            for part in body.split(";"):
                name, _, value = part.partition(":")
                name, value = name.strip().lower(), value.strip()
                if not name or not value:
                    continue
                important = value.lower().endswith("!important")
                value = re.sub(r"(?i)\s*!important$", "", value)
                for n, v in expand(name, value):
                    out.append((selector, spec, seq, n, v, important))
                    seq += 1
    return out


def expand(name: str, value: str) -> list[tuple[str, str]]:
    """A box shorthand by the number of its values: all; vertical and horizontal; top, sides, bottom; each side."""
    if name not in SHORTHANDS:
        return [(name, value)]
    v = value.split()
    sides = {1: (0, 0, 0, 0), 2: (0, 1, 0, 1), 3: (0, 1, 2, 1), 4: (0, 1, 2, 3)}.get(len(v))
    return [(f"{name}-{s}", v[i]) for s, i in zip(("top", "right", "bottom", "left"), sides, strict=True)] if sides else []


def css_rules(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The rules of each page's style elements."""
    css = pages.select(key, F.array_join(F.regexp_extract_all("html", F.lit("(?s)<style[^>]*>(.*?)</style>"), F.lit(1)), "\n").alias("css"))

    def run(it):
        for pdf in it:
            rows = [(k, *r) for k, c in zip(pdf[key], pdf["css"], strict=True) for r in parse_css(c)]
            yield pd.DataFrame(rows, columns=[key, "selector", "specificity", "seq", "property", "value", "important"])

    return css.mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, selector string, specificity long, seq long, property string, value string, important boolean")


def cascade(elements: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """key, element, property, value: the winning rule of each element. elements: key, element, tag, class, id.

    A compound selector meets elements through its most selective name (id, else class, else tag), an equi-join, and the
    other names are checked then; important beats specificity beats order."""
    r = rules.withColumn("rid", F.regexp_extract("selector", "#([\\w-]+)", 1)).withColumn("rclass", F.regexp_extract("selector", "\\.([\\w-]+)", 1)).withColumn("rtag", F.lower(F.regexp_extract("selector", "^([a-zA-Z][\\w-]*)", 1)))
    r = r.withColumn("via", F.when(F.col("rid") != "", F.concat(F.lit("#"), "rid")).when(F.col("rclass") != "", F.concat(F.lit("."), "rclass")).otherwise(F.col("rtag")))
    names = F.array(F.concat(F.lit("#"), F.coalesce("id", F.lit(""))), F.lower("tag"))
    e = elements.withColumn("via", F.explode(F.array_distinct(F.concat(names, F.transform(F.split(F.coalesce("class", F.lit("")), " "), lambda c: F.concat(F.lit("."), c))))))
    met = e.join(r, [key, "via"]).where(((F.col("rid") == "") | (F.col("rid") == F.col("id"))) & ((F.col("rtag") == "") | (F.col("rtag") == F.lower("tag"))) & ((F.col("rclass") == "") | F.array_contains(F.split(F.coalesce("class", F.lit("")), " "), F.col("rclass"))))
    w = W.partitionBy(key, "element", "property").orderBy(F.col("important").desc(), F.col("specificity").desc(), F.col("seq").desc())
    return met.withColumn("n", F.row_number().over(w)).where("n = 1").select(key, "element", "property", "value")


# List numbering ---------------------------------------------------------------------------------------------------------


def count_items(items: list[tuple]) -> list[list[int]]:
    """Counters of list items in order: (level, num_id, start by level, override or None, deleted).

    An item's level goes up by one, or begins at its start (or a num_id's override, once); levels above keep their count,
    or their start if they had none; deeper ones are forgotten. A deleted item shows its number but doesn't advance."""
    state: dict[int, int] = {}
    used: set = set()
    out = []
    for level, num_id, starts, override, deleted in items:
        new = {i: state.get(i, starts[i]) for i in range(level)}
        if override is not None and num_id not in used:
            new[level] = override
        else:
            new[level] = state[level] + 1 if level in state else starts[level]
        out.append([new[i] for i in range(level + 1)])
        if not deleted:
            if override is not None:
                used.add(num_id)
            state = new
    return out


def list_counters(items: DataFrame, key: list[str], order: str, starts: list[int]) -> DataFrame:
    """key, order, counters of list items (level, num_id, override, deleted); a list is numbered in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rows = [(int(lv), n, starts, None if pd.isna(o) else int(o), bool(d)) for lv, n, o, d in zip(pdf["level"], pdf["num_id"], pdf["override"], pdf["deleted"], strict=True)]
        return pdf[[*key, order]].assign(counters=count_items(rows))

    kinds = dict(items.dtypes)
    return items.groupBy(*key).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in [*key, order]) + ", counters array<long>")


def level_text(template: str, counters, formats: list):
    """%1.%2 with each counter in its format (functions of a column)."""
    out = F.lit(template)
    for i, f in enumerate(formats, 1):
        out = F.replace(out, F.lit(f"%{i}"), F.coalesce(f(F.get(counters, F.lit(i - 1))), F.lit("")))
    return out
