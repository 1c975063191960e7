"""Queries of the subpackage that have SQL agree with DuckDB, column by column and row by row."""

import duckdb
import pytest

from tracewright.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, DIR)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    here = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    assert here == sorted(tuple(map(plain, r)) for r in want.select(*columns).fetchall())
    assert here
