"""The vector index: model, exact search by bounds, filters, odd rows, and the bucketed plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkloom.operators import search, vector_index


def clustered(n, seed=3, dims=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return (centres[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, dims))).tolist()


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, v, i % 3) for i, v in enumerate(clustered(1500))]
    rows += [(2000 + i, [0.0] * 10, 1) for i in range(3)] + [(2100 + i, rows[5][1], 2) for i in range(200)] + [(2500, None, 0)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, kind int").repartition(4)


@pytest.fixture(scope="module")
def queries(corpus):
    return corpus.where("id % 50 = 0 and embedding is not null").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in df.collect())


def test_exact_is_nearest(corpus, queries, monkeypatch):
    monkeypatch.setattr(vector_index, "SLOT", 60)  # large lists are cut into slots
    index = vector_index.build(corpus, carry=("kind",))
    assert len(index.sizes) > len(index.model.fine) and index.sizes.sum() == 1703
    assert rows_of(vector_index.exact(index, queries, 7)) == rows_of(search.nearest(corpus, queries, 7, -1.0, metric="cosine"))
    one = corpus.where("kind = 1")
    assert rows_of(vector_index.exact(index, queries, 5, where="kind = 1")) == rows_of(search.nearest(one, queries, 5, -1.0, metric="cosine"))
    few = corpus.where("id in (7, 9)")
    assert rows_of(vector_index.exact(index, queries, 5, where="id in (7, 9)")) == rows_of(search.nearest(few, queries, 5, -1.0, metric="cosine"))
    assert rows_of(vector_index.exact(index, queries, 4, 0.95, metric="certainty")) == rows_of(search.nearest(corpus, queries, 4, 0.95))
    vector_index.dropped(index)


def test_work_is_pruned(corpus, queries):
    index = vector_index.build(corpus)
    row = vector_index.report(index, queries, 10).first()
    assert row["recall"] >= 0.9 and row["scored"] < 0.1 and row["scored_exact"] < 0.3 and row["rows"] == 1703
    found = vector_index.search(index, queries, 10, probes=0.2)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    vector_index.dropped(index)


def test_codes_are_read_without_a_shuffle(corpus, queries):
    index = vector_index.build(corpus)
    asked = vector_index._asked(index, queries.withColumn("reach", F.lit(9.0)), lambda model, radius, x, reach: np.ones((len(x), len(radius)), bool))
    plan = vector_index._read(index, index.rows, asked, lambda far, *_: np.arange(len(far)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # only the queries move
    vector_index.dropped(index)


def test_nothing(spark, corpus, queries):
    assert vector_index.build(corpus.limit(0)) is None
    assert vector_index.build(corpus.where("embedding is null")) is None
    index = vector_index.build(corpus.where("id = 7"))
    assert rows_of(vector_index.exact(index, queries.limit(0), 3)) == []
    assert {r[2] for r in rows_of(vector_index.exact(index, queries, 3))} == {7}


def test_bounds_hold(corpus):
    """A row is never farther from its code than its error, nor from its centre than the radius."""
    index = vector_index.build(corpus)
    m = index.model
    for r in index.rows.collect():
        x = vector_index._unit(np.array([r["embedding"]]))
        centre = m.fine[np.searchsorted(m.first, r["slot"], side="right") - 1]
        code = np.frombuffer(r["code"], np.uint8)
        near = centre + m.codes[np.arange(len(code)), code].ravel()[: x.shape[1]]
        assert np.linalg.norm(x[0] - near) <= r["error"] + 1e-9 and abs(np.linalg.norm(x[0] - centre) - r["dist"]) < 1e-9
        assert r["dist"] <= index.radius[r["slot"]] + 1e-12
    vector_index.dropped(index)
