"""Column generation against bounds, exhaustive search and exact placement."""

import itertools
import random

import numpy as np
import pytest
from sparkloom.llm import packing


def best_by_search(lengths, values, capacity):
    best = 0.0
    for counts in itertools.product(*(range(capacity // n + 1) for n in lengths)):
        if sum(n * c for n, c in zip(lengths, counts)) <= capacity:
            best = max(best, sum(v * c for v, c in zip(values, counts)))
    return best


def test_pricing_against_search():
    rng = random.Random(4)
    for _ in range(20):
        lengths = sorted(rng.sample(range(3, 20), 4))
        values = [rng.random() for _ in lengths]
        value, pattern = packing.best_pattern(np.array(lengths), np.array(values), 24)
        assert abs(value - best_by_search(lengths, values, 24)) < 1e-9
        assert pattern @ np.array(lengths) <= 24 and abs(pattern @ np.array(values) - value) < 1e-9
        copies = np.array([rng.randrange(1, 4) for _ in lengths])
        full = packing.fullest_pattern(np.array(lengths), copies, 3, 24)
        assert full[3] >= 1 and (full <= copies).all()
        reach = {sum(n * c for n, c in zip(lengths, k)) for k in itertools.product(*(range(c + 1) for c in copies)) if k[3]}
        assert full @ np.array(lengths) == max(x for x in reach if x <= 24)


@pytest.mark.parametrize("low, high", [(1, 1024), (300, 1024), (520, 1024), (1, 200)])
def test_levels_are_close_to_a_proven_bound(low, high):
    rng = random.Random(low)
    demand = {rng.randrange(low, high): rng.randrange(1, 60) for _ in range(150)}
    lengths = np.array(sorted(demand))
    need = np.array([demand[n] for n in lengths.tolist()], float)
    columns, x, bound = packing.solved(lengths, need, 1024)
    assert np.allclose(columns @ x, need, atol=1e-3) and (lengths @ columns <= 1024).all() and (x >= 0).all()
    assert need @ lengths / 1024 - 1e-6 <= bound <= x.sum() + 1e-6
    assert x.sum() <= bound + max(packing.LEAST, packing.GAP * bound) + 1e-6


def test_most_rests_come_through_patterns():
    """Rests as the test tables have them: nearly all stay whole, and patterns place them."""
    rng = random.Random(9)
    demand = {}
    for _ in range(20_000):
        n = min(1023, int(rng.lognormvariate(5.9, 0.8)) + 1)
        demand[n] = demand.get(n, 0) + 1
    plan = packing.Plan(demand, 1024)
    assert plan.whole >= 0.95 * sum(demand.values())
    assert plan.sequences <= -(-sum(n * k for n, k in demand.items()) // 1024) + 10


@pytest.mark.parametrize("seed", range(6))
def test_every_token_lies_in_one_place(seed):
    rng = random.Random(seed)
    low = rng.choice([1, 1, 20, 40])
    demand = {rng.randrange(low, 64): rng.randrange(1, 9) for _ in range(30)}
    plan, seen = packing.Plan(demand, 64), {}
    for n, k in demand.items():
        for rank in range(k):
            at = 0
            for start, size, sequence, offset in plan.pieces(n, rank):
                assert start == at and size > 0 and offset + size <= 64
                at += size
                seen.setdefault(sequence, []).append((offset, size))
            assert at == n
    for own in seen.values():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end == 64 or end & (end - 1) == 0
    assert sorted(seen) == list(range(plan.sequences))


def test_nothing_to_pack():
    assert packing.patterns({}, 1024) == [] and packing.Plan({}, 1024).sequences == 0
