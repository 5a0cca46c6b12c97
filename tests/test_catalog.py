"""Every query with an oracle agrees with DuckDB on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from skein.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 9)
    if hasattr(x, "as_tuple"):
        return round(float(x), 9)
    return str(x) if hasattr(x, "year") else x


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(plain(r[k]) for k in at)) for r in data)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, oracle, name):
    query, sql = CATALOG[name]
    df = query(spark, SF)
    got = df.collect()
    if sql is None:
        assert got
        return
    want = oracle.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
