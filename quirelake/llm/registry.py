"""All queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("audit", "decontaminate", "html", "lines", "lm", "packing", "partenum", "quality", "repair", "sharding", "suffixes", "urls", "warc")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"quirelake.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"quirelake.llm.{m}").ORACLES.items()}
