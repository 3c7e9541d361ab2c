"""A normal form of XML, so that documents that say the same have one digest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Deeper elements are an error.
DEEPEST = 256
SPACE = " \t\r\n"
XML = "http://www.w3.org/XML/1998/namespace"


def digest(xml: str | None, defaults: dict[tuple[str, str], str] | None = None) -> tuple[str | None, str | None]:
    """SHA-256 of a document's canonical tokens, and why there is none.

    Names are expanded by their namespaces, so prefixes and their declarations don't matter; attributes stand in order of
    names, without those that have their default (defaults: by element and attribute); pieces of text are one; blank text
    goes, unless xml:space keeps it; comments and processing instructions go. A document type is refused."""
    if xml is None:
        return None, "null"
    sha, text, keep = hashlib.sha256(), [], [False]

    def put(kind: str, *values: str) -> None:
        for v in (kind, *values):
            b = v.encode("utf-8", "surrogatepass")
            sha.update(len(b).to_bytes(8, "big") + b)

    def flush() -> None:
        t = "".join(text)
        text.clear()
        if t.strip(SPACE) or (t and keep[-1]):
            put("text", t)

    def start(name: str, attributes: dict) -> None:
        flush()
        if len(keep) > DEEPEST:
            raise ValueError("too deep")
        own = {k: v for k, v in attributes.items() if (defaults or {}).get((name, k)) != v}
        put("start", name, *[x for k in sorted(own) for x in (k, own[k])])
        keep.append({"preserve": True, "default": False}.get(attributes.get(f"{XML} space"), keep[-1]))

    def end(name: str) -> None:
        flush()
        keep.pop()
        put("end")

    def refuse(*_: object) -> None:
        raise ValueError("document type")

    p = expat.ParserCreate(namespace_separator=" ")
    p.buffer_text, p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.StartDoctypeDeclHandler = True, start, end, text.append, refuse
    try:
        p.Parse(xml, True)
    except (expat.ExpatError, ValueError) as e:
        return None, str(e).split(":")[0]
    return sha.hexdigest(), None


def digests(table: DataFrame, column: str, defaults: dict[tuple[str, str], str] | None = None, digest_of: Callable = digest) -> DataFrame:
    """table with xml_digest and xml_error of a column of XML texts. Equal digests are deep equality, so it is a join."""

    def run(frames):
        for pdf in frames:
            found = [digest_of(x if isinstance(x, str) else None, defaults) for x in pdf[column]]
            yield pdf.assign(xml_digest=[d for d, _ in found], xml_error=[e for _, e in found])

    return table.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in table.dtypes) + ", xml_digest string, xml_error string")


def deep_equal(left: DataFrame, right: DataFrame, keys: list[str], column: str, defaults: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """keys, equal of two tables' XML: null if either isn't well-formed or missing."""
    side = lambda df, name: digests(df.select(*keys, column), column, defaults).select(*keys, F.col("xml_digest").alias(name))
    return side(left, "__l").join(side(right, "__r"), keys, "full").select(*keys, (F.col("__l") == F.col("__r")).alias("equal"))
