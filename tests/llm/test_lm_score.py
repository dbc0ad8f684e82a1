"""The language model against plain sums, and its training by shards."""

import numpy as np
from sparkloom.llm import attention, lm_score
from sparkloom.llm.attention import DIM, NONE, STEP, SYMBOLS, TAIL

from .conftest import prose

VOCABULARY = SYMBOLS + 2 * TAIL + 9


def counted(streams):
    counts = np.zeros(VOCABULARY)
    for s in streams:
        np.add.at(counts, s[1:], 1)
    pairs, symbol = np.zeros((SYMBOLS, SYMBOLS)), attention.symbols(counts)
    for s in streams:
        np.add.at(pairs, (symbol[s[:-1]], symbol[s[1:]]), 1)
    return counts, pairs


def windows_of(streams):
    return lm_score._windows(np.concatenate(streams), np.array([len(s) for s in streams]), np.arange(len(streams), dtype=np.uint64) << np.uint64(32), np.uint64(2**63 - 1))[0]


def some_streams(seed=5):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, VOCABULARY, n).astype(np.uint16) for n in (2, 3, 17, 18, 40, 100)] + [np.array([7, 7], np.uint16)]


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def plainly(model, stream):
    """log10 of every id of a stream but the first, token by token."""
    code, p, out = model.code[stream], {k: v.astype(np.float64) for k, v in model.p.items()}, []
    for t in range(1, len(stream)):
        window = range(max(0, (t - 1) // STEP * STEP - STEP), t)
        e = p["E"][code[t - 1]]
        scores = np.array([e @ p["Q"] @ (p["E"][code[j]] @ p["K"]) / DIM**0.5 + p["far"][t - 1 - j] for j in window])
        mix = softmax(scores) @ np.array([p["E"][code[j]] @ p["V"] for j in window])
        h = np.maximum(p["D"][code[t - 1]] + mix @ p["O"] + p["h"], 0)
        target = int(code[t])
        symbol = target if target < SYMBOLS else model.rare
        c, m = divmod(symbol, attention.MEMBERS)
        own = softmax(h @ p["C"] + p["c"])[c] * softmax(h @ p["M"][c] + p["m"][c])[m]
        pair = float(model.table[code[t - 1] if code[t - 1] < SYMBOLS else model.rare, symbol])
        if target >= SYMBOLS:
            c, m = divmod(target - SYMBOLS, TAIL)
            own *= softmax(h @ p["G"] + p["g"])[c] * softmax(h @ p["T"][c] + p["t"][c])[m]
            pair *= float(model.tail[target - SYMBOLS])
        out.append(np.log10(model.gate * own + (1 - model.gate) * pair))
    return np.array(out)


def test_scores_against_plain_sums():
    streams = some_streams()
    model = attention.Model(*counted(streams))
    model.weigh(model.train(windows_of(streams), passes=3))
    found = model.log10(streams, at_once=3)
    assert [len(x) for x in found] == [len(s) - 1 for s in streams]
    for x, s in zip(found, streams):
        assert np.allclose(x, plainly(model, s), atol=2e-4)
    changed = streams[5].copy()
    changed[60:] = 9
    assert np.allclose(model.log10([changed])[0][:59], found[5][:59], atol=1e-5)  # nothing looks ahead


def test_probabilities_of_all_ids_sum_to_one():
    streams = some_streams()
    model = attention.Model(*counted(streams))
    model.train(windows_of(streams))
    start = streams[5][:30]
    every = model.log10([np.append(start, i).astype(np.uint16) for i in range(VOCABULARY)])
    assert abs(sum(10 ** x[-1] for x in every) - 1) < 1e-3


def test_gradients():
    rng = np.random.default_rng(6)
    model = attention.Model(*counted(some_streams()))
    for k, v in model.p.items():
        model.p[k] = v.astype(np.float64) + (0.05 * rng.normal(size=v.shape) if k in "GT" else 0)
    model.tables()
    x, y = model.code[rng.integers(0, VOCABULARY, (3, 2 * STEP))], model.code[rng.integers(0, VOCABULARY, (3, STEP))]
    x[0, :14], y[1, 10:] = model.pad, model.pad
    _, grads = model.gradients(x, y)
    assert set(grads) == set(model.p)
    for name, g in grads.items():
        p = model.p[name]
        at = np.unravel_index(np.argmax(np.abs(g)), p.shape)
        old, values = p[at], []
        for e in (1e-3, -1e-3):
            p[at] = old + e
            model.tables()
            values.append(model.gradients(x, y)[0])
        p[at] = old
        assert abs((values[0] - values[1]) / 2e-3 - g[at]) < 2e-3 + 0.05 * abs(g[at]), name


def test_every_step_sees_the_weights_as_they_are(monkeypatch):
    monkeypatch.setattr(attention, "BATCH", 2)
    real = attention.Model._learned

    def checked(self, x, y):
        found, fresh = real(self, x, y), attention.Model(*counts)
        fresh.p = self.p
        fresh.tables()
        assert np.allclose(found[0], real(fresh, x, y)[0], atol=1e-5)
        return found

    streams = [s for seed in range(8) for s in some_streams(seed)]
    counts = counted(streams)
    model = attention.Model(*counts)
    monkeypatch.setattr(attention.Model, "_learned", checked)
    model.train(windows_of(streams))


def test_sums_by_number():
    rng = np.random.default_rng(7)
    for n, size in ((1, 1), (5, 3), (40, 700), (70_000, 90)):
        at, rows = rng.integers(0, n, size), rng.normal(size=(size, 3))
        plain = np.zeros((n, 3))
        np.add.at(plain, at, rows)
        assert np.allclose(attention._added(at, np.concatenate([rows, np.zeros((1, 3))]), n), plain)


def test_windows_cover_every_target_once():
    streams = [np.arange(n).astype(np.uint16) for n in (2, 3, 17, 18, 100)]
    every = windows_of(streams)
    targets = every[:, 2 * STEP :]
    assert sorted(targets[targets != NONE].tolist()) == sorted(x for s in streams for x in s[1:].tolist())
    some, drawn = lm_score._windows(np.concatenate(streams), np.array([len(s) for s in streams]), np.zeros(5, np.uint64), np.uint64(2**62))
    assert 0 < len(some) < len(every) and (drawn < 2**62).all()


def test_training_does_not_depend_on_partitions_and_grows(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(lm_score, "LEAST", 100)
    monkeypatch.setattr(lm_score, "SHARD", 60)
    path, models = public_tokenizers.path("word_bpe_49k.json"), []
    for n, size in ((3, 300), (1, 300), (3, 900)):
        docs = spark.createDataFrame([(i, prose(i, 60)) for i in range(size)], "doc_id long, text string")
        blocks = lm_score._blocks(docs.repartition(n), path).cache()
        seen = []
        real = lm_score._round
        monkeypatch.setattr(lm_score, "_round", lambda *a: (seen.append(a[3]), real(*a)))
        models.append((lm_score.train(blocks), seen[0]))
        monkeypatch.setattr(lm_score, "_round", real)
        blocks.unpersist()
    (a, _), (b, small), (_, large) = models
    assert np.allclose(a.p["E"], b.p["E"], atol=1e-4) and abs(a.gate - b.gate) < 1e-4
    assert large > 1.5 * small  # windows trained on follow the corpus


def test_runs_hold_every_window_once():
    streams = [np.arange(n).astype(np.uint16) for n in (2, 17, 18, 512, 513, 514, 1025, 1500)]
    length = lm_score.RUN * STEP
    runs = [lm_score._run(s, n) for s in streams for n in range(-(-(len(s) - 1) // length))]
    assert sorted(lm_score._windows_of_runs(runs).tolist()) == sorted(windows_of(streams).tolist())


def test_every_training_target_is_learned_once_at_any_size(spark, monkeypatch):
    import public_tokenizers

    seen, real = [], attention.Model.weigh
    monkeypatch.setattr(attention.Model, "weigh", lambda self, bins: (seen.append(int(bins.sum())), real(self, bins)))
    monkeypatch.setattr(lm_score, "LEAST", 100)  # the rule used to change here
    for size in (4, 40, 400):
        docs = spark.createDataFrame([(i, prose(i, 2000 if i % 50 == 2 else 20)) for i in range(size)], "doc_id long, text string")
        blocks = lm_score._blocks(docs, public_tokenizers.path("word_bpe_49k.json")).cache()
        seen.clear()
        lm_score.train(blocks)
        targets = sum(n + 1 for r in blocks.select("n_ids", "held").collect() for n, held in zip(r["n_ids"], r["held"]) if not held)
        assert sum(seen) == targets > 0, size
        blocks.unpersist()


def test_large_corpora_take_fewer_steps_a_window():
    for windows in (1_000_000, 10_000_000, 600_000_000):  # a round's
        shards = lm_score._shards(windows)
        own = round(windows / shards)
        assert shards * -(-own // lm_score._step(own)) * 700 <= windows  # 256 before
    for windows in (1, 40, 10_000, 177_000):  # and small ones more steps than they had
        own = round(windows / lm_score._shards(windows))
        assert -(-own // lm_score._step(own)) >= min(100, -(-own // 256))


def test_given_windows_of_a_step(monkeypatch):
    seen, real = [], attention.Model._learned
    monkeypatch.setattr(attention.Model, "_learned", lambda self, x, y: (seen.append(len(x)), real(self, x, y))[1])
    streams = some_streams()
    windows = windows_of(streams)
    bins = attention.Model(*counted(streams)).train(windows, batch=7)
    assert max(seen) == 7 and sum(seen) == len(windows) and bins.sum() == (windows[:, 2 * STEP :] != NONE).sum()


def test_logits_out_of_bounds():
    rng = np.random.default_rng(8)
    x, w = attention._with_ones(rng.normal(size=(5, 3)).astype(np.float32)), rng.normal(size=(4, 6)).astype(np.float32)
    for scale, move in ((1, 0), (40, 0), (4000, 0), (1, -300), (1, 300)):
        own = w * np.float32(scale)
        own[-1] += move
        logit = (x @ own).astype(np.float64)
        shares = np.array([softmax(r) for r in logit])
        e, picked, total = attention._exponentials(x, own, np.arange(5) * 6 + 2)
        assert np.allclose(e / total[:, None], shares, atol=1e-5)
        assert np.allclose(picked - np.log(total), logit[:, 2] - logit.max(axis=1) - np.log(np.exp(logit - logit.max(axis=1, keepdims=True)).sum(axis=1)), atol=1e-4, rtol=1e-5)
    streams = some_streams()
    model = attention.Model(*counted(streams))
    model.p["Q"] *= 4000
    model.tables()
    assert all(np.isfinite(x).all() for x in model.log10(streams))
    part = model.code[windows_of(streams)]
    assert all(np.isfinite(g).all() for g in model.gradients(part[:, : 2 * STEP], part[:, 2 * STEP :])[1].values())


def test_gate_is_weighed_on_counts():
    model = attention.Model(np.ones(VOCABULARY), np.ones((SYMBOLS, SYMBOLS)))
    bins = np.zeros(attention.BINS, np.int64)
    bins[attention.BINS // 2 + 400] = 900
    bins[attention.BINS // 2 - 400] = 100
    model.weigh(bins)
    assert 0.85 < model.gate <= 0.99
    model.weigh(bins[::-1])
    assert 0.01 <= model.gate < 0.15


def test_held_out_text_scores_better_than_by_pairs_and_base(spark):
    """Sentences whose next word depends on an earlier one, which pairs of symbols can't see."""
    import public_tokenizers

    def text(i):
        return " ".join(("one red is warm and" if (i * 7 + j * j) % 3 else "two blue is cold and") for j in range(60))

    docs = spark.createDataFrame([(i, text(i)) for i in range(1500)], "doc_id long, text string")
    rows = [r for r in lm_score.score(docs, public_tokenizers.path("word_bpe_49k.json")).collect() if r["held_out"]]
    assert len(rows) > 50 and sum(r["score"] for r in rows) > 0.5 * sum(r["base_score"] for r in rows)
