"""Language-model scores of documents: a counted base and a self-attention model.

The scan writes blocks of documents (about ``BLOCK`` characters each) to the shared
folder: their subword ids, and their words as places in the block's sorted list of word
hashes.  Hash ranges of those lists meet in one task each, which sums the training counts
of every word in the corpus and sends each block its words' counts back; no word, however
common, is more than one entry a block.

Id and symbol-pair counts cover all training documents; what reaches the driver of them is
bounded by the vocabulary and by ``SYMBOLS`` squared.  The attention weights are trained on
the executors with every window of every training document, once, by one rule at every size:
a hash deals runs of windows to rounds, and in a round to shards whose number grows with the
corpus.  In each round every shard goes over its windows from the same start in about ``STEPS``
steps, and the shards' changes are averaged by windows; the last round also sets the mixture's
gate.

Words are compared by 64-bit hashes (at a billion distinct words about one pair collides
in 40 corpora).  Defined results: null text counts as empty; an empty text has its end
alone.  Repeated rows are scored alike and both counted in training.  Without training
documents every token is unknown and the model is its starting state.  An empty table
gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import attention
from .attention import NONE, STEP, SYMBOLS
from .common import fold, parts, read, settings, shared_dir, stored, words
from .minhash import mixed
from .tokens import encoder

BLOCK = 6_000_000
#: Rounds of training, and successive windows of a text that are dealt as one row.
ROUNDS, RUN = 3, 32
#: Was the number of windows below which training took another share of them.  No size does
#: any more and nothing reads it; it stays for the test that sets it.
LEAST = 0
#: Windows of a shard (in expectation), and of those of a round with at most ``FEW`` shards;
#: the steps in which a shard is gone over, and a step's least windows (what a step costs apart
#: from its windows falls with their number, and shards of more windows lose less by averaging).
SHARD, SMALL, FEW, STEPS, STEP_WINDOWS = 131_072, 65_536, 8, 128, 32
#: The unit in which shards' changes are summed, so that sums don't depend on their order; the
#: slices in which they are summed, of which those that no shard changes are not sent.
UNIT, SLICES = 2.0**40, 256
#: Runs that are cut into windows at once.
CUT = 256
#: Ids of the vocabulary (fixed values): all, and the one for a text's start and end.
VOCABULARY, END = 49_408, 49_407


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^24 as their three bytes, plane by plane (which compresses well)."""
    return b"".join((x >> s & 255).astype(np.uint8).tobytes() for s in (0, 8, 16))


def _from_planes(data: bytes) -> np.ndarray:
    a, b, c = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.uint32)
    return a | b << np.uint32(8) | c << np.uint32(16)


def _blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    def made(k: int, rows: list[tuple]) -> pa.RecordBatch:
        ids = encoder(tokenizer).many([t for _, t, _ in rows])
        found, sizes = [], []
        for _, t, _ in rows:
            w = words(t)
            found.append(b"".join(map(xxhash.xxh3_64_digest, w)))
            sizes.append(len(w))
        keys, place = np.unique(np.frombuffer(b"".join(found), np.uint64), return_inverse=True)
        learn = np.array([not held for _, _, held in rows])
        counts = np.bincount(place[np.repeat(learn, sizes)], minlength=len(keys)).astype(np.int64)
        values = (
            ([(TaskContext.get().partitionId() << 12) + k], pa.int64()), ([[d for d, _, _ in rows]], pa.list_(pa.int64())), ([[h for _, _, h in rows]], pa.list_(pa.bool_())),
            ([[len(i) for i in ids]], pa.list_(pa.int32())), ([np.concatenate(ids).tobytes()], pa.binary()), ([sizes], pa.list_(pa.int32())), ([_planes(place)], pa.binary()),
            ([keys.tobytes()], pa.binary()), ([counts.tobytes()], pa.binary()), ([int(learn.sum())], pa.int64()),
        )
        names = ["block", "doc_ids", "held", "n_ids", "ids", "n_words", "places", "keys", "counts", "learned"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], names)

    def cut(batches):
        rows, size, k = [], 0, 0
        for b in batches:
            for d, t, held in zip(*(c.to_pylist() for c in b.columns)):
                rows.append((d, t or "", held))
                size += len(t or "") + 64
                if size >= BLOCK:
                    yield made(k, rows)
                    rows, size, k = [], 0, k + 1
        if rows:
            yield made(k, rows)

    docs = docs.select("doc_id", "text", (fold(F.col("doc_id"), 10) == 0).alias("held"))
    return docs.mapInArrow(cut, "block long, doc_ids array<long>, held array<boolean>, n_ids array<int>, ids binary, n_words array<int>, places binary, keys binary, counts binary, learned long")


def _word_counts(blocks: DataFrame) -> DataFrame:
    """``block, part, c, tokens, distinct``: corpus counts of each block's words, in order of
    parts; the last two are a part's totals, on one of its rows."""
    total = blocks.agg(F.sum(F.length("keys"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / 8 / 1_000_000))))

    def split(batches):
        for b in batches:
            out = [[] for _ in range(4)]
            for block, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                ends = np.searchsorted(part, np.arange((1 << bits) + 1))
                for p in np.unique(part).tolist():
                    for column, v in zip(out, (p, block, keys[ends[p] : ends[p + 1]].tobytes(), counts[ends[p] : ends[p + 1]].tobytes())):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "keys", "counts"])

    def summed(group: list[tuple]) -> pa.RecordBatch:
        keys = [np.frombuffer(k, np.uint64) for _, _, k, _ in group]
        own = np.concatenate([np.frombuffer(c, np.int64) for *_, c in group])
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.zeros(len(known), np.int64)
        np.add.at(c, place, own)
        found = np.split(c[place], np.cumsum([len(k) for k in keys])[:-1])
        first = [1] + [0] * (len(group) - 1)
        columns = ([g[1] for g in group], [g[0] for g in group], [x.tobytes() for x in found], [int(c.sum()) * f for f in first], [int((c > 0).sum()) * f for f in first])
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], ["block", "part", "c", "tokens", "distinct"])

    def meet(batches):
        group: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[0][0] != row[0]:
                    yield summed(group)
                    group = []
                group.append(row)
        if group:
            yield summed(group)

    rows = blocks.select("block", "keys", "counts").mapInArrow(split, "part int, block long, keys binary, counts binary")
    rows = rows.repartition(parts(blocks.sparkSession), "part").sortWithinPartitions("part", "block")
    return rows.mapInArrow(meet, "block long, part int, c binary, tokens long, distinct long")


def _streams(ids: bytes, sizes: list[int]) -> list[np.ndarray]:
    """Each text's ids with its start and end."""
    flat, ends = np.frombuffer(ids, np.uint16), np.cumsum([0, *sizes])
    side = np.array([END], np.uint16)
    return [np.concatenate([side, flat[a:b], side]) for a, b in zip(ends, ends[1:])]


def _windows(flat: np.ndarray, sizes: np.ndarray, keys: np.ndarray, bar: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Windows of streams that lie one after the other, as far as their hash (from their
    stream's key and their number) lies below the bar: ``2 * STEP`` inputs, then ``STEP``
    targets; and their hashes."""
    begins, last = np.cumsum(sizes) - sizes, sizes - 1
    count = -(-last // STEP)
    doc = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    drawn = mixed(nth.astype(np.uint64) + keys[doc]) >> np.uint64(1)
    some = np.flatnonzero(drawn < bar)
    doc, at = doc[some], (begins[doc] + nth * STEP)[some]
    first, end = begins[doc][:, None], (begins + last)[doc][:, None]
    inputs, targets = at[:, None] + np.arange(-STEP, STEP), at[:, None] + np.arange(1, STEP + 1)
    x = np.where((inputs < first) | (inputs >= end), NONE, flat[np.clip(inputs, 0, len(flat) - 1)])
    y = np.where(targets > end, NONE, flat[np.minimum(targets, len(flat) - 1)])
    return np.concatenate([x, y], axis=1).astype(np.uint16), drawn[some]


def _learning(ids: bytes, sizes: list[int], docs: list, held: list[bool]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A block's training streams; then, of each of their runs of ``RUN`` windows: its stream,
    its number there and its hash (from the id and that number)."""
    learn = [(s, d or 0) for s, d, h in zip(_streams(ids, sizes), docs, held) if not h]
    streams = [s for s, _ in learn]
    keys = np.array([d * 0x9E3779B97F4A7C15 & 2**64 - 1 for _, d in learn], np.uint64)
    count = np.array([-(-(len(s) - 1) // (RUN * STEP)) for s in streams], np.int64)
    of = np.repeat(np.arange(len(streams)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return streams, of, nth, mixed(nth.astype(np.uint64) + keys[of])


def _run(stream: np.ndarray, nth: int) -> np.ndarray:
    """A run of a stream: the ``STEP`` ids before (``NONE`` where the text begins), then those
    that its windows take as inputs, and the last target."""
    begin, end = nth * RUN * STEP, (nth + 1) * RUN * STEP + 1
    before = stream[begin - STEP : begin] if nth else np.full(STEP, NONE, np.uint16)
    return np.concatenate([before, stream[begin:end]])


def _windows_of_runs(runs: list[np.ndarray]) -> np.ndarray:
    """All windows of runs; the first that is cut from a run has what is before it as targets."""
    if len(runs) > CUT:  # places take eight times as much as ids
        return np.concatenate([_windows_of_runs(runs[a : a + CUT]) for a in range(0, len(runs), CUT)])
    sizes = np.array([len(r) for r in runs])
    windows, _ = _windows(np.concatenate(runs), sizes, np.zeros(len(runs), np.uint64), np.uint64(2**63))
    count = -(-(sizes - 1) // STEP)
    return np.delete(windows, np.cumsum(count) - count, axis=0)


def _mixed_up(windows: np.ndarray, salt: int) -> np.ndarray:
    """Windows in an order that follows from their content and ``salt`` alone."""
    key = np.full(len(windows), salt, np.uint64)
    for column in windows.T:
        key = key * np.uint64(0x9E3779B97F4A7C15) + column
    return windows[np.argsort(mixed(key), kind="stable")]


def _shards(windows: float) -> int:
    """Shards of a round of so many windows."""
    return max(1, min(FEW, round(windows / SMALL)), round(windows / SHARD))


def _step(windows: int) -> int:
    """Windows of a step of a shard of so many."""
    return max(STEP_WINDOWS, -(-windows // STEPS))


def _round(blocks: DataFrame, model: attention.Model, nth: int, available: int, shards: int) -> None:
    """One round on its ``available`` windows: every shard trains from ``model``, whose weights
    move by their average."""
    spark = blocks.sparkSession
    names = sorted(model.p)
    shared = spark.sparkContext.broadcast(model)  # bounded: the vocabulary's 20 MB

    def learned(group: list[bytes], sums: np.ndarray, bins: np.ndarray) -> None:
        start = shared.value
        own = copy.copy(start)
        own.p = {k: v.copy() for k, v in start.p.items()}
        windows = _mixed_up(_windows_of_runs([np.frombuffer(r, np.uint16) for r in group]), nth)
        bins += own.train(windows, nth / ROUNDS, (nth + 1) / ROUNDS, batch=_step(len(windows)))
        at = 0
        for k in names:
            old, new = start.p[k], own.p[k]
            moved = np.flatnonzero((new != old).reshape(len(new), -1).any(axis=1))  # of many ids and classes, few
            change = (new[moved] - old[moved]).astype(np.float64)
            sums[at : at + old.size].reshape(old.shape)[moved] += np.rint(change * (len(windows) / available * UNIT)).astype(np.int64)
            at += old.size

    def dealt(batches):
        for b in batches:
            for block in zip(*(c.to_pylist() for c in b.columns)):
                streams, of, number, key = _learning(*block)
                own = np.flatnonzero(key % np.uint64(ROUNDS) == nth)
                to = (key[own] // np.uint64(ROUNDS) % np.uint64(shards)).astype(np.int32)
                runs = [_run(streams[i], n).tobytes() for i, n in zip(of[own].tolist(), number[own].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(runs, pa.binary())], ["shard", "run"])

    def meet(batches):
        sums, bins, group, now = np.zeros(sum(v.size for v in shared.value.p.values()), np.int64), np.zeros(attention.BINS, np.int64), [], None
        for b in batches:
            for shard, run in zip(*(c.to_pylist() for c in b.columns)):
                if group and now != shard:
                    learned(group, sums, bins)
                    group = []
                now = shard
                group.append(run)
        if group:
            learned(group, sums, bins)
        if bins.any():
            rows = [(i, part) for i, part in enumerate([*np.array_split(sums, SLICES), bins]) if part.any()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([part.tobytes() for _, part in rows], pa.binary())], ["x", "n"])

    def halved(batches):  # changes as the weights' type
        for b in _totals(batches):
            rows = [n if x == SLICES else (np.frombuffer(n, np.int64) / UNIT).astype(np.float32).tobytes() for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["x", "n"])

    tasks = min(parts(spark), shards)
    drawn = blocks.select("ids", "n_ids", "doc_ids", "held").mapInArrow(dealt, "shard int, run binary")
    drawn = drawn.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard")
    sums = drawn.mapInArrow(meet, "x int, n binary").repartition(min(SLICES, parts(spark)), "x").mapInArrow(halved, "x int, n binary")
    changes, bins = np.zeros(sum(v.size for v in model.p.values()), np.float32), np.zeros(attention.BINS, np.int64)
    slices = np.array_split(changes, SLICES)  # views
    for r in sums.collect():
        if r["x"] == SLICES:
            bins = np.frombuffer(r["n"], np.int64)
        else:
            slices[r["x"]][:] = np.frombuffer(r["n"], np.float32)
    at = 0
    for k in names:
        size = model.p[k].size
        model.p[k] += changes[at : at + size].reshape(model.p[k].shape)
        at += size
    model.tables()
    model.weigh(bins)
    shared.destroy()


def _totals(batches):
    """Sums of the number lists that have the same ``x``."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[x] = sums.get(x, 0) + np.frombuffer(n, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["x", "n"])


def train(blocks: DataFrame) -> attention.Model:
    """The fitted model."""
    spark = blocks.sparkSession

    def look(batches):
        counts = np.zeros(VOCABULARY + ROUNDS, np.int64)  # of ids, then of each round's windows
        for b in batches:
            for block in zip(*(c.to_pylist() for c in b.columns)):
                streams, of, number, key = _learning(*block)
                if not streams:
                    continue
                counts[:VOCABULARY] += np.bincount(np.concatenate(streams), minlength=VOCABULARY)
                counts[END] -= len(streams)  # starts are given
                windows = -(-(np.array([len(s) for s in streams])[of] - 1) // STEP) - number * RUN
                np.add.at(counts, VOCABULARY + (key % np.uint64(ROUNDS)).astype(np.int64), np.minimum(windows, RUN))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["x", "n"])

    counts = np.zeros(VOCABULARY + ROUNDS)
    for r in blocks.select("ids", "n_ids", "doc_ids", "held").mapInArrow(look, "x int, n long").groupBy("x").agg(F.sum("n").alias("n")).collect():
        counts[r["x"]] = r["n"]
    counts, available = counts[:VOCABULARY], counts[VOCABULARY:].astype(np.int64).tolist()
    symbol = attention.symbols(counts)

    def pair(batches):
        table = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for b in batches:
            for ids, sizes, held in zip(*(c.to_pylist() for c in b.columns)):
                flat = [symbol[s] for s, h in zip(_streams(ids, sizes), held) if not h]
                for at in range(0, len(flat), 2000):
                    key = np.concatenate([s[:-1] * SYMBOLS + s[1:] for s in flat[at : at + 2000]])
                    table += np.bincount(key, minlength=SYMBOLS * SYMBOLS)
        table = table.reshape(SYMBOLS, SYMBOLS)
        rows = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([table[r].tobytes() for r in rows], pa.binary())], ["x", "n"])

    pairs = np.zeros((SYMBOLS, SYMBOLS))
    rows = blocks.select("ids", "n_ids", "held").mapInArrow(pair, "x int, n binary").repartition(parts(spark), "x").mapInArrow(_totals, "x int, n binary")
    for r in rows.collect():
        pairs[r["x"]] = np.frombuffer(r["n"], np.int64)
    model = attention.Model(counts, pairs)
    shards = _shards(sum(available) / ROUNDS)
    for nth, windows in enumerate(available):
        if windows:
            with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):  # a round's text is shuffled for it alone
                _round(blocks, model, nth, windows, shards)
    return model


def score(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    raw = _blocks(docs, tokenizer)
    path = f"{shared_dir(spark)}/blocks"
    raw.write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(raw.schema).parquet(path)
    counts = stored(_word_counts(blocks), "word_counts")
    sums = counts.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    ends = blocks.agg(F.sum("learned")).first()[0] or 0
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    floor = math.log10(n + 0.1 * (v + 1))
    at_end = math.log10(ends + 0.1) - floor

    def base(batches):
        for b in batches:
            for block, sizes, places, found in zip(*(c.to_pylist() for c in b.columns)):
                c = np.frombuffer(b"".join(x["c"] for x in found or ()), np.int64)[_from_planes(places)] if places else np.empty(0, np.int64)
                cut = np.cumsum([0, *sizes])
                known, logs = np.cumsum([0, *(c > 0)]), np.log10(c + 0.1) - floor
                scores = [math.fsum(logs[i:j]) + at_end for i, j in zip(cut, cut[1:])]
                columns = (
                    pa.array(range(block << 20, (block << 20) + len(sizes)), pa.int64()), pa.array([s + 1 for s in sizes], pa.int64()),
                    pa.array(known[cut[1:]] - known[cut[:-1]] + (ends > 0), pa.int64()), pa.array(scores, pa.float64()),
                )
                yield pa.RecordBatch.from_arrays(list(columns), ["row", "n_tokens", "n_known", "base_score"])

    shared = spark.sparkContext.broadcast(train(blocks))  # bounded: 20 MB

    def attend(batches):
        model = shared.value
        for b in batches:
            for block, docs, held, sizes, ids in zip(*(c.to_pylist() for c in b.columns)):
                streams = _streams(ids, sizes)
                distinct: dict[bytes, int] = {}
                which = [distinct.setdefault(s.tobytes(), len(distinct)) for s in streams]
                own = [np.frombuffer(s, np.uint16) for s in distinct]
                found = [float(x.sum()) for x in model.log10(own)]
                columns = (pa.array(range(block << 20, (block << 20) + len(docs)), pa.int64()), pa.array(docs, pa.int64()), pa.array(held, pa.bool_()), pa.array([found[i] for i in which], pa.float64()))
                yield pa.RecordBatch.from_arrays(list(columns), ["row", "doc_id", "held_out", "score"])

    gathered = counts.groupBy(F.col("block").alias("b")).agg(F.array_sort(F.collect_list(F.struct("part", "c"))).alias("found"))
    known = blocks.select("block", "n_words", "places").join(gathered, F.col("block") == F.col("b"), "left").select("block", "n_words", "places", "found")
    known = known.mapInArrow(base, "row long, n_tokens long, n_known long, base_score double")
    model = blocks.select("block", "doc_ids", "held", "n_ids", "ids").mapInArrow(attend, "row long, doc_id long, held_out boolean, score double")
    return model.join(known, "row").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
