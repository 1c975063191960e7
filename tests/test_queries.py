"""Every query over the derived views runs; those with SQL agree with DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tracewright.plans.catalog import ORACLES, QUERIES

DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


def rows(frame: pd.DataFrame) -> list:
    def plain(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT:
            return "null"
        if isinstance(x, float):
            return f"{x:.6g}"
        return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    assert len(got)
