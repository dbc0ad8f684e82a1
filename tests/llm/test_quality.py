"""Quality classifier: features over pieces, learning, and held-out accuracy of the query."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkloom.llm import quality

DIR = "/root/testdata/sf0.01"


def rows_of(text):
    return sorted(np.concatenate(list(quality.features(text))).tolist())


def brute(text):
    """The same features, word by word."""

    def h(cps):
        x = 0
        for c in cps:
            x = (x * 0x100000001B3 + c) % (1 << 64)
        return x

    def row(x, kind):
        x = (x + kind) * 0x9E3779B97F4A7C15 % (1 << 64)
        return ((x ^ x >> 29) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - quality.BITS)

    import re

    found, words = [row(0, 99)], []
    for w in re.findall("[^\x20\x09-\x0d]+", text):
        cps = [ord(x) for x in w]
        words.append((sum(c * pow(0x100000001B3, i + 1, 1 << 64) for i, c in enumerate(cps)) + len(cps) * 0x9E3779B97F4A7C15) % (1 << 64))
        for n in quality.RUNS:
            marked = [32, *cps, 32]
            found += [row(h(marked[i : i + n]), 10 + n) for i in range(len(marked) - n + 1)]
    found += [row(w, 1) for w in words]
    found += [row((b * 0x100000001B3 + a) % (1 << 64), 2) for a, b in zip(words, words[1:])]
    found += [row(sum((i >= k and words[i] == words[i - k]) << k for k in (1, 2, 3)), 3) for i in range(len(words))]
    return sorted(found)


@pytest.mark.parametrize("text", ["", "a", " \t\n", "one two two one one", "é 日本 a\U0001f600b  x", "Wort, Wort! WORT!!\nzu zu zu zu"])
@pytest.mark.parametrize("piece", [1 << 18, 1, 5])
def test_features_by_brute_force(monkeypatch, text, piece):
    monkeypatch.setattr(quality, "PIECE", piece)
    assert rows_of(text) == brute(text)


def test_null_counts_as_empty():
    assert rows_of(None) == rows_of("")


def test_odd_rows(spark, odd_dir, empty_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 1), (100, 0), (101, None), (102, 7), (None, 1), (109, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = quality.scored(docs, model, keep=["doc_id", "text", "key", "bucket"]).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    by_text = {}
    for r in found:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(x) == 1 for x in by_text.values())
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.scored(docs, None).collect()} == {0.5}
    none = spark.read.parquet(f"{empty_dir}/documents.parquet")
    assert quality.fit(none, labels) is None and quality.scored(none, model).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
def test_held_out_accuracy(spark):
    found = quality.op13_quality(spark, DIR)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["quality"], r["predicted"]) for r in rows if r["held_out"] and r["quality"] is not None]
    assert sum(p for y, p in held if y == 1) >= 0.98 * sum(y == 1 for y, _ in held)
    assert sum(p for y, p in held if y == 0) <= 0.2 * sum(y == 0 for y, _ in held)
