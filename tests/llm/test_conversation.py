"""Conversation repair against a plain search over strings, on odd rows and on split conversations."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F
from sparkloom.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string, key string, id long, n int, blank string"


def damage(rows):
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        for _ in range((k != 0) + (k == 3)):
            yield conv, turn, "user" if k == 4 else role, text


def brute(rows):
    """Cheapest edits, then least letters, by relaxing all states after each row."""
    after = {"s": 1, "u": 2, "a": 3}
    out = []
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())
    by = {}
    for r in damage(rows):
        by.setdefault(r[0], []).append(r)
    for conv in dict.fromkeys(r[0] for r in rows):
        mine, seen, counts = sorted(by.get(conv, []), key=order), set(), [0, 0, 0]
        states = {0: (0, "", ())}

        def relaxed(states):
            states = dict(states)
            for _ in range(8):
                for s, (c, a, o) in list(states.items()):
                    new = "a" if s == 2 else "u"
                    x = (c + 5, a + "I", (*o, {"u": "user", "a": "assistant"}[new] + ":"))
                    states[after[new]] = min(states.get(after[new], x), x)
            return states

        for _, _, role, text in mine:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            new = {}

            def offer(s, x):
                new[s] = min(new.get(s, x), x)

            for s, (c, a, o) in relaxed(states).items():
                offer(s, (c + 2, a + "D", o))
                if fault in (0, 1):
                    continue
                late, legal = 5 * (fault == 2), "a" if s == 2 else "u"
                if role[:1] == "" or role[:1] == legal or (role[:1] == "s" and s == 0):
                    offer(after[role[:1]] if role[:1] else s, (c + late, a + "K", (*o, f"{role}:{text}")))
                offer(after[legal], (c + 1 + late, a + "R", (*o, f"{'user' if legal == 'u' else 'assistant'}:{text}")))
            states = new
        c, a, o = min(x for s, x in relaxed(states).items() if s in (0, 3))
        turns = [t for _, t, *_ in mine if t is not None]
        bad = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(mine, mine[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, bad, c, a, hashlib.sha256("\n".join(o).encode()).hexdigest()))
    return sorted(out, key=str)


def odd(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "ultra"]
    texts = ["Yes.", "No", "ok!", "", None, " \t", "Why? ", "é.", "end. x", " "]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 9)):
            t = rng.choice([turn, turn, turn, turn + rng.randint(0, 3), None])
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                rows.append((conv, t, rng.choice(roles[: rng.choice([3, 5, 10])]), rng.choice(texts)))
    rows += [(7, i % 300, rng.choice(roles[:5]), rng.choice(texts[:3])) for i in range(600)]
    return rows


def found(df):
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 3), (3, 1), (4, 2)])
def test_by_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(conversation, "BLOCK", block)
    rows = odd(seed)
    docs = spark.createDataFrame([(*r, "k", 5, 1, None) for r in rows], SCHEMA).repartition(3)
    assert found(conversation.repair(docs)) == brute(rows)


def test_blocks_agree_with_one():
    """A conversation cut anywhere has the walk that it has in one block."""
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(1, 12)
        rows = [(rng.choice(["u", "a", "s", "", "x"]), rng.choice([0, 0, 0, 1, 2, 4]), rng.choice([1, 1, 2, 3])) for _ in range(n)]
        start = [0, conversation.FAR, conversation.FAR, conversation.FAR]
        whole = conversation.Block(*map(list, zip(*rows))).walks(start, conversation.END, True)[0][1]
        cuts = sorted({0, n, *rng.sample(range(n + 1), min(n, 3))})
        parts = [conversation.Block(*map(list, zip(*rows[a:b]))) for a, b in zip(cuts, cuts[1:])]
        ahead, behind = [start], [conversation.END]
        for p in parts:
            m = p.matrix()
            ahead.append([min(ahead[-1][a] + m[4 * a + b] for a in range(4)) for b in range(4)])
        for p in reversed(parts[1:]):
            m = p.matrix()
            behind.append(conversation.back([min(m[4 * a + b] + behind[-1][b] for b in range(4)) for a in range(4)]))
        behind.reverse()
        state, letters = 0, ""
        for k, p in enumerate(parts):
            state, more = p.walks(ahead[k], behind[k], k == len(parts) - 1)[state]
            letters += more
        assert letters == whole


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation.repair(none).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "x", None, None, None, None)], SCHEMA)
    assert found(conversation.repair(one)) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert conversation.repair(one.withColumn("conv_id", F.lit("a")).where("false")).count() == 0
