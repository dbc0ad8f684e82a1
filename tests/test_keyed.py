"""Keyed tables in versions: updates, lookups, conflicts, failed writers."""

import json
import random

import pytest
from pyspark.sql import functions as F
from sparkloom.sources.keyed import KeyedTable, json_set
from sparkloom.sources.versions import Conflict

SCHEMA = "id string, n int, meta string"


def rows_of(df):
    return {r["id"]: (r["n"], json.loads(r["meta"]) if r["meta"] else None) for r in df.collect()}


def test_json_set(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"x":[1]}}', '{"b":2.5,"c":null}'), (None, '{"a":1}'), ('{"a":1}', None), ("bad", '{"z":true}'), (None, None)], "o string, n string")
    found = [r[0] and json.loads(r[0]) for r in df.select(json_set(F.col("o"), F.col("n"))).collect()]
    assert found == [{"a": 1, "b": 2.5, "c": None}, {"a": 1}, {"a": 1}, {"z": True}, None]


def test_updates(spark, tmp_path):
    rng, state = random.Random(3), {}
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", 4)
    assert table.read().count() == 0 and table.get(spark.createDataFrame([("a",)], "id string")).count() == 0
    for step in range(5):
        keys = [f"k{i}" for i in rng.sample(range(40), 15)]
        if step in (0, 2):
            rows = [(k, rng.randint(0, 9), json.dumps({"v": step}), o) for k in keys for o in (1, 2)]
            table.put(spark.createDataFrame(rows, SCHEMA + ", o int").repartition(3), "o")
            state |= {k: (n, json.loads(m)) for k, n, m, o in rows if o == 2}
        elif step == 3:
            table.delete(spark.createDataFrame([(k,) for k in keys], "id string"))
            state = {k: v for k, v in state.items() if k not in keys}
        else:
            rows = [(k, rng.choice([None, 50]), json.dumps({f"w{step}": [1]})) for k in keys]
            table.patch(spark.createDataFrame(rows, SCHEMA), ["meta"])
            state |= {k: (state[k][0] if n is None else n, state[k][1] | json.loads(m)) for k, n, m in rows if k in state}
        assert rows_of(table.read()) == state
        some = spark.createDataFrame([(k,) for k in ("k1", "k2", "k3", "nowhere")], "id string")
        assert rows_of(table.get(some)) == {k: v for k, v in state.items() if k in ("k1", "k2", "k3")}
    table.compacted()
    assert len(table.versions.runs()) == 1 and rows_of(table.read()) == state


def test_lookup_opens_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", 8)
    table.put(spark.createDataFrame([(f"k{i}", i, None) for i in range(100)], SCHEMA))
    plan = table.get(spark.createDataFrame([("k1",)], "id string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_failed_and_second_writers(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", 4)
    table.put(spark.createDataFrame([("a", 1, None)], SCHEMA))
    bad = spark.createDataFrame([("a", 2, None)], SCHEMA).withColumn("meta", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.put(bad)
    assert rows_of(table.read()) == {"a": (1, None)} and table.versions.current() == 1
    run = table._write(spark.createDataFrame([("b", 1, None)], SCHEMA).withColumn("gone", F.lit(False)))
    table.put(spark.createDataFrame([("c", 1, None)], SCHEMA))  # another writer is first
    with pytest.raises(Conflict):
        table.versions.publish([*table.versions.runs(1), run], 1)
    assert rows_of(table.read()) == {"a": (1, None), "c": (1, None)}
