"""Every operator of tests/literal_rows.py gives the rows that stand there."""

import duckdb
import literal_rows
import pytest
from test_catalog import rows


@pytest.mark.parametrize("name", sorted(literal_rows.QUERIES))
def test_rows(spark, name):
    query, sql = literal_rows.QUERIES[name]
    df = query(spark, "")
    want = duckdb.connect().execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())
