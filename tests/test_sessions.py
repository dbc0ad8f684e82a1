"""Chains of sessions through stored lists, by walking them one by one."""

import random

import pytest
from sparkloom.operators import sessions


def walked(lists, start, most=5):
    chain, at, seen = [], start, set()
    while at in lists and at not in seen and len(chain) < most:
        seen.add(at)
        for x in lists[at] or []:
            if x is not None and x != start and x not in chain:
                chain.append(x)
        known = [x for x in lists[at] or [] if x is not None]
        at = known[-1] if known else None
    return chain[:most]


@pytest.mark.parametrize("seed, most", [(1, 5), (2, 5), (3, 2), (4, 9), (5, 1)])
def test_linked_chain(spark, seed, most):
    rng = random.Random(seed)
    lists = {f"s{i}": [rng.choice([f"s{rng.randint(max(0, i - 3), min(119, i + 1))}", "gone", None, f"s{i}"][: rng.choice([1, 1, 1, 4])]) for _ in range(rng.randint(0, 2))] for i in range(120)}
    lists |= {"a": ["b"], "b": ["c"], "c": ["a"], "self": ["self"], "x": ["a", "b"], "none": None}
    df = spark.createDataFrame(list(lists.items()), "session_id string, related array<string>").repartition(3)
    found = {r["session_id"]: r["chain"] for r in sessions.linked_chain(df, most=most).collect()}
    assert found == {s: walked(lists, s, most) for s in lists}


def test_nothing(spark):
    assert sessions.linked_chain(spark.createDataFrame([], "session_id long, related array<long>")).count() == 0
