"""Quality classifier: learned subword embeddings, averaged over a document.

Each word, pair of neighbouring words, run of 3 to 5 characters of a word (its ends
marked) and pattern of equal words among four neighbours is hashed to a row of a table
of vectors.  A document is the mean of its rows over whole texts; a linear layer and a
softmax give the probability of label 1.  Table and layer are learned together by
stochastic gradient descent in numpy.

The model is fitted on at most ``ROWS`` labelled documents, those whose ids have the
least hashes: each is reduced to counts of table rows where it lies, and one task of
bounded input trains.  Every text is scored, with all its words.

Defined results: null text counts as empty; an empty text has only the mark that ends
each text, whose vector is learned, too.  Labels other than 0 and 1 are ignored, several
of one id count by majority (a tie as 1).  Of training rows with one id the least text is
used; rows without an id are never trained on and are held out.  Without any label
every score is 0.5.  Equal texts have equal scores.  Only the named columns are read, so
others may clash freely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, fresh, read

#: Labelled documents at most, rows of the table (a power of two), their dimensions.
ROWS, BITS, DIM = 4096, 16, 16
#: Passes over the training rows, first step size, seed.
EPOCHS, RATE, SEED = 12, 2.0, 20240613
#: Lengths of character runs, and characters that are hashed at once.
RUNS, PIECE = (3, 4, 5), 1 << 18
#: From this score on a document is predicted to be of label 1.
BAR = 0.3

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64))


def _rows(h: np.ndarray, kind: int) -> np.ndarray:
    """Rows of the table for hashes of a kind of feature."""
    h = (h + np.uint64(kind)) * _ODD
    return ((h ^ h >> np.uint64(29)) * _ODD >> np.uint64(64 - BITS)).astype(np.int64)


_END = _rows(np.zeros(1, np.uint64), 99)


def features(text: str | None):
    """Table rows of the text's features, repeats included, piece by piece."""
    yield _END
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    before, at = np.empty(0, np.uint64), 0
    while at < len(c):
        end = min(len(c), at + PIECE)
        if end < len(c):  # cut between words; a longer word stays whole
            gaps = np.flatnonzero(_blank(c[at:end]))
            while not len(gaps) and end < len(c):
                at_most = min(len(c), end + PIECE)
                gaps = np.flatnonzero(_blank(c[end:at_most])) + end - at
                end = at_most
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        rows, before = _piece(c[at:end], before)
        yield from rows
        at = end


def _blank(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13))


def _piece(c: np.ndarray, before: np.ndarray):
    """Rows of one piece by kind, and its last word hashes; ``before`` are those of the piece before."""
    blank = np.concatenate([[True], _blank(c), [True]])
    c = np.where(blank, 32, np.concatenate([[0], c, [0]])).astype(np.uint64)
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(starts):
        return [], before
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    inside = np.flatnonzero(~blank)
    sizes = ends - starts
    place = np.arange(len(inside)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    words = np.add.reduceat(c[inside] * _POWERS[place % len(_POWERS)], np.cumsum(sizes) - sizes) + sizes.astype(np.uint64) * _ODD
    rows = [_rows(words, 1)]
    all_words = np.concatenate([before, words])
    new = len(before)
    pairs = all_words[max(1, new) :] * _BASE + all_words[max(1, new) - 1 : -1]
    rows.append(_rows(pairs, 2))
    same = np.zeros(len(all_words), np.uint64)
    for k in (1, 2, 3):
        same[k:] |= (all_words[k:] == all_words[:-k]).astype(np.uint64) << np.uint64(k)
    rows.append(_rows(same[new:], 3))
    for n in RUNS:
        if len(c) < n:
            break
        windows = np.zeros(len(c) - n + 1, np.uint64)
        whole = np.ones(len(windows), bool)
        for j in range(n):
            windows = windows * _BASE + c[j : len(c) - n + 1 + j]
            if 0 < j < n - 1:
                whole &= ~blank[j : len(c) - n + 1 + j]
        rows.append(_rows(windows[whole], 10 + n))
    return rows, all_words[-3:]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text, and the part of all its features that each has."""
    total = np.zeros(1 << BITS, np.int64)
    for rows in features(text):
        total += np.bincount(rows, minlength=len(total))
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / total.sum()).astype(np.float32)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """What each table row adds to the difference of the two classes' logits, after descent over
    documents (table rows, their parts, label)."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = np.zeros((2, DIM), np.float32)
    step, steps = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, part, label = rows[i]
            mean = part @ table[at]
            logits = layer @ mean
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            rate = RATE * (1 - step / steps)
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            table[at] -= rate * np.outer(part, back)
            step += 1
    return (table @ (layer[1] - layer[0])).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> np.ndarray | None:
    """The model of ``learn`` for labelled rows of ``docs``; None if there are none."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id"))
    known = known.agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    there = docs.select(F.col(doc_id).alias("id")).distinct()
    sample = known.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(ROWS)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def counted(batches):
        for b in batches:
            found = [counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([p.tobytes() for _, p in found], pa.binary())], ["id", "label", "at", "part"])

    def trained(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("id", "label", "at", "part"))), key=lambda r: r[0])
        model = learn([(np.frombuffer(at, np.int32), np.frombuffer(part, np.float32), y) for _, y, at, part in rows])
        return pa.table({"model": pa.array([model.tobytes()], pa.binary())})

    kind = docs.schema[doc_id].dataType.simpleString()
    reduced = chosen.select("id", "label", "text").mapInArrow(counted, f"id {kind}, label int, at binary, part binary")
    model = reduced.groupBy(F.lit(0).alias("one")).applyInArrow(trained, "model binary").collect()
    return np.frombuffer(model[0]["model"]) if model else None


def scored(docs: DataFrame, model: np.ndarray | None, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``score``, the probability of label 1."""

    def score(batches):
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                total, n = 0.0, 0
                for rows in features(t) if model is not None else ():
                    total, n = total + float(model[rows].sum()), n + len(rows)
                out.append(0.5 if not n else float(1 / (1 + np.exp(min(-total / n, 700.0)))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.float64())], [*b.schema.names[1:], "score"])

    source = docs.select(F.col(text).alias(fresh(keep, "__text")), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(score, f"{fields}, score double")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    model = fit(docs.where(~F.col("held_out")), read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))
    return scored(docs, model, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= BAR).cast("int"))
