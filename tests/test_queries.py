"""Every query against its SQL in DuckDB, at the smallest scale."""

import math
import os

import pytest
from sparkloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def values(rows, names):
    def one(v):
        if isinstance(v, float):
            return "none" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return "none" if v is None else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in found.collect()]
    if name not in catalog.SQL:
        assert found.columns
        return
    expected = duck.sql(catalog.SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert values(rows, found.columns) == values(expected.fetchall(), expected.columns)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(DIR):
        assert __spark_entry__.entry(spark).count() > 0
