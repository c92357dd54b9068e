"""Every query with SQL against DuckDB."""

import math

import duckdb
import pytest

from millrace.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.5e}"
    return repr(value)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = tables.execute(ORACLES[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in at) for row in found.fetchall())
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert got == want
