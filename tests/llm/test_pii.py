"""The random field against exhaustive sums, and texts that are long or odd."""

import itertools
import time

import numpy as np
import pytest
from sparkloom.llm import pii


@pytest.mark.parametrize("edges", [[(0, 0, 1), (1, 1, 2)], [(0, 0, 1), (0, 1, 2), (1, 2, 3)], [(1, 0, 3), (0, 3, 4), (1, 3, 1), (0, 1, 2)]])
def test_messages_are_exact_on_trees(edges):
    rng = np.random.default_rng(len(edges))
    field = pii.Field([])
    field.weights = rng.normal(size=field.weights.shape)
    field.edges = np.array([(e + e.T) / 2 for e in rng.normal(size=(2, 5, 5))])
    fields = [pii._fields(t, k) for t, k in (("a@b.c", 1), ("12.3", 0), ("+49", 4), ("77", 0), ("x1", 2))][: 1 + max(max(i, j) for _, i, j in edges)]
    node, exact = field._rows(fields) @ field.weights, np.zeros((len(fields), 5))
    for labels in itertools.product(range(5), repeat=len(fields)):
        weight = np.exp(sum(node[i, y] for i, y in enumerate(labels)) + sum(field.edges[k, labels[i], labels[j]] for k, i, j in edges))
        for i, y in enumerate(labels):
            exact[i, y] += weight
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.allclose(field.beliefs(fields, edges), exact, atol=2e-3)


def test_slices_do_not_change_beliefs(monkeypatch):
    text = "call +1 (239) 555-8522 or 2395558522 " * 20
    field = pii.Field([(("n", *pii._fields("2395558522", 0), 4), 5), (("e", 1, 4, 4, 0, 0, 0, 0), 9)])
    whole = field.added(text, pii.base_spans(text))
    monkeypatch.setattr(pii, "SLICE", 7)
    assert field.added(text, pii.base_spans(text)) == whole


LONG = ["0" * 5000 + ".1.1.1", "9" * 200_000, "a" * 500_000 + " x@y.zz 1", "@" * 100_000, "+1(" * 50_000, "1." * 100_000, "a@b.c " * 20_000, "1 2-" * 100_000, "1.2.3." + "0" * 9000 + "7"]


@pytest.mark.parametrize("k", range(len(LONG)))
def test_long_texts(k):
    began, spans = time.process_time(), pii.base_spans(LONG[k])
    pii.Field([]).added(LONG[k], spans)
    assert time.process_time() - began < 20
    if k in (0, 8):
        assert [s[0] for s in spans] == [1] and spans[0][1:] == (0, len(LONG[k]))


def test_long_digit_runs_reach_query_and_masking(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(LONG)], "doc_id long, text string, n_chars long")
    field = pii.fit(docs)
    found = {r["doc_id"]: r["n_ip"] for r in pii.find(docs, field).collect()}
    assert found[0] == 1 and found[8] == 1 and found[1] == 0
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs, field).collect()}
    assert masked[0] == "[IP]" and len(masked) == len(LONG)
