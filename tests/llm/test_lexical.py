"""Ranked lexical search: codes, merge, and whole results by brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from sparkloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    docs = [(i, cut(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = Counter(x for _, t in docs for x in set(t))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    rows = []
    for item, terms in asked.items():
        scores = []
        for i, t in docs:
            tf, m = Counter(t), 10 + (90 * len(t) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in terms if tf[x])
            if s > 0:
                scores.append((-s, i is None, i))
        rows += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(rows, key=str)


def test_codes():
    values = np.array([0, 1, 127, 128, 300, 1 << 35, (1 << 63) - 1, 5])
    data, ends = lexical.encode(values)
    assert lexical.decode(data.tobytes()).tolist() == values.tolist() and ends[-1] == len(data)
    assert lexical.decode(b"").tolist() == []


def test_terms():
    for text in ("A-b_C 9é日!x\x00y\x7fz\u0085q", "", "ÄB ab\tAB", "a\U0001f600b"):
        assert [t.decode() for t in lexical.terms(text.encode())] == cut(text)


def test_documents_of_a_shard():
    shard = lexical.Shard()
    for i, t in ((5, b"x y"), (None, b""), (-(1 << 62), b"z"), (1 << 62, b"x"), (5, b"")):
        shard.add(i, t)
    ids, lengths = lexical.documents(next(shard.batches(0)).column(4)[0].as_py())
    assert ids == [-(1 << 62), 5, 5, 1 << 62, None] and lengths.tolist() == [1, 2, 0, 1, 0]


@pytest.mark.parametrize("seed", range(30))
def test_merge_is_exact(seed):
    rng = random.Random(seed)
    lists = []
    for _ in range(rng.randint(0, 9)):
        places = sorted(rng.sample(range(60), rng.randint(0, 60)))
        top = rng.choice((1, 3, 50))
        lists.append((np.array(places, np.int64), np.array([rng.randint(0, top) for _ in places], np.int64)))
    sums = Counter()
    for p, a in lists:
        for x, y in zip(p.tolist(), a.tolist()):
            sums[x] += y
    k = rng.choice((1, 3, 10))
    expected = sorted(((s, p) for p, s in sums.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    assert sorted(lexical.best(lists, k), key=lambda x: (-x[0], x[1])) == expected


@pytest.mark.parametrize("limit, items_a_block, broadcast", [(1 << 21, 1024, 16 << 20), (7, 1, 0)])
def test_search_by_brute_force(spark, odd_dir, tmp_path, monkeypatch, limit, items_a_block, broadcast):
    monkeypatch.setattr(lexical, "ITEMS", items_a_block)
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", broadcast)
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "The quick lazy fox"), (1, "wizards"), (2, None), (None, "no ID jumps"), (3, ""), (4, "nowhere-seen"), (5, "x é 日本 1 2")]
    monkeypatch.setattr(lexical, "POSTINGS", limit)
    index = lexical.build(docs, str(tmp_path / "index"))
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(rows, items)


def test_nothing(spark, empty_dir, tmp_path):
    index = lexical.build(spark.read.parquet(f"{empty_dir}/documents.parquet"), str(tmp_path / "index"))
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(index, items).collect() == []
    assert lexical.search(index, items.limit(0)).collect() == []
