"""Every query that has SQL gives the same rows as DuckDB; the others run and have rows."""

import duckdb
import pytest

from quirelake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def rows(columns, found):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in by], sorted(repr(tuple(r[i] for i in by)) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert rows(df.columns, got) == rows(columns, want.fetchall())
