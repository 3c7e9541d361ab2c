"""All queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from quirelake.plans import q_blocks, q_compose, q_css, q_search, q_sheets, q_verify, q_document, q_edits, q_streams, q_layout, q_lineage, q_package, q_rules, q_runs, q_script, q_structure

MODULES = (q_blocks, q_compose, q_css, q_search, q_sheets, q_verify, q_document, q_edits, q_streams, q_layout, q_lineage, q_package, q_rules, q_runs, q_script, q_structure)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
