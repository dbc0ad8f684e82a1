"""Queries that SQL can express, against DuckDB at the smallest scale."""

import os

import pytest
from sparkloom.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        c.sql(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    expected = c.sql(registry.SQL[name])
    found = registry.QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expected.select(*columns).fetchall())
