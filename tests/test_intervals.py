"""Unions of intervals, rows within them, and lines around targets."""

import random

import pytest
from sparkloom.operators import intervals


def brute(rows):
    out = []
    for key in sorted({k for k, s, e in rows if k is not None and s is not None and e is not None and s < e}):
        mine, n = sorted((s, e) for k, s, e in rows if k == key and None not in (s, e) and s < e), 0
        first, reach = None, None
        for s, e in mine:
            if reach is None or s > reach:
                if reach is not None:
                    out.append((key, first, reach, n))
                first, reach, n = s, e, 0
            reach, n = max(reach, e), n + 1
        out.append((key, first, reach, n))
    return sorted(out)


@pytest.mark.parametrize("block, seed", [(4096, 1), (1, 2), (7, 3), (50, 4)])
def test_merged(spark, monkeypatch, block, seed):
    monkeypatch.setattr(intervals, "BLOCK", block)
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), s := rng.randint(-300, 300), s + rng.choice([0, 1, 2, 5, 40, -3])) for _ in range(300)]
    rows += [(None, 1, 2), ("a", None, 3), ("d", 5, None), ("e", -9, 900), ("e", 3, 4), ("e", 900, 901)]
    df = spark.createDataFrame(rows, "k string, start long, end long")
    assert sorted(tuple(r) for r in intervals.merged(df, "k").collect()) == brute(rows)


def test_inside(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BIN", 4)
    spans = spark.createDataFrame([("a", -6, 3), ("a", 10, 30), ("b", 0, 1)], "k string, start long, end long")
    rows = spark.createDataFrame([(k, p) for k in "abc" for p in range(-10, 40)], "k string, p long")
    found = {(r["k"], r["p"], r["start"]) for r in intervals.inside(rows, spans, "k", "p").collect()}
    assert found == {("a", p, -6) for p in range(-6, 3)} | {("a", p, 10) for p in range(10, 30)} | {("b", 0, 0)}


def around(text, targets, n):
    lines = text.split("\n")
    keep = sorted({i for t in targets if 0 <= t < len(lines) for i in range(max(0, t - n), min(len(lines), t + n + 1))})
    out = []
    for i in keep:
        if i > 0 and i - 1 not in keep:
            out.append("# ...")
        out.append(lines[i])
    return "\n".join(out + ["# ..."] * (bool(keep) and keep[-1] < len(lines) - 1))


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_line_context(spark, n):
    rng = random.Random(n)
    docs = [(i, "\n".join(f"{i}.{j}" if j % 4 else "" for j in range(rng.randint(1, 60)))) for i in range(20)] + [(50, None), (51, ""), (52, "x")]
    targets = [(i, rng.randint(-1, 60)) for i in range(18) for _ in range(rng.randint(0, 6))] + [(0, 3), (0, 3), (50, 0), (51, 0), (99, 1), (None, 1), (1, None)]
    found = intervals.line_context(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(targets, "id long, line int"), around=n)
    expected = {i: around(t, [x for k, x in targets if k == i and x is not None], n) for i, t in docs if t is not None and any(k == i and x is not None and 0 <= x < len(t.split("\n")) for k, x in targets)}
    assert {r["id"]: r["context"] for r in found.collect()} == expected
