"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1.  A trigram is bound as the
product of its letters' vectors, each rotated by its place; a text is the sum of
its trigrams' vectors; a language's prototype is the sum over its training texts.
A text gets the language whose prototype has the largest cosine with it.

Defined results: null text, empty text and texts without a letter give ``und``
with score 0; so does everything when nothing can be learned.  Languages that tie
go to the smaller name.  Repeated rows are independent.  Only the named columns
are read, so others may clash freely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, fresh, read

#: Dimensions of a vector, seed of the letters' vectors, and distinct letter codes.
DIM, SEED, LETTERS = 512, 20240607, 128
UNKNOWN = "und"
#: Bound on trigram vectors that one worker keeps (half a KB each).
KEPT = 40_000


def _code(cp: int) -> int:
    """0 for what is no letter; own codes for a-z and U+00DF-U+00FF; other letters share 68."""
    if not chr(cp).isalpha():
        return 0
    if 97 <= cp <= 122:
        return cp - 96
    if 0xDF <= cp <= 0xFF:
        return cp - 0xDF + 27
    return 60 + (cp * 2654435761 >> 16) % 68


class Trigrams:
    """Trigram codes and vectors; one per worker."""

    def __init__(self) -> None:
        self.table = np.array([_code(c) for c in range(65536)], np.int32)
        base = np.random.default_rng(SEED).integers(0, 2, (LETTERS, DIM)).astype(np.int8) * 2 - 1
        self.places = [np.roll(base, k, axis=1) for k in (2, 1, 0)]
        self.forget()

    def forget(self) -> None:
        self.row = np.full(LETTERS**3, -1, np.int32)
        self.vectors, self.used = np.empty((4096, DIM), np.int8), 0

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of the text, word ends included, and how often each occurs."""
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        ids = self.table[np.minimum(cp, 65535)]
        for i in np.flatnonzero(cp > 65535):
            ids[i] = _code(int(cp[i]))
        ids = np.concatenate([[0], ids, [0]])
        ids = ids[(ids != 0) | np.concatenate([[True], ids[:-1] != 0])]
        if len(ids) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.unique((ids[:-2] * LETTERS + ids[1:-1]) * LETTERS + ids[2:], return_counts=True)

    def bundle(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, ``n`` times each."""
        total = np.zeros(DIM, np.float64)
        for at in range(0, len(codes), KEPT):
            part = codes[at : at + KEPT]
            new = part[self.row[part] < 0]
            if len(new):
                if self.used + len(new) > KEPT:
                    self.forget()
                    new = part
                while self.used + len(new) > len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                self.row[new] = np.arange(self.used, self.used + len(new))
                a, b, c = new // LETTERS**2, new // LETTERS % LETTERS, new % LETTERS
                np.multiply(self.places[0][a] * self.places[1][b], self.places[2][c], out=self.vectors[self.used : self.used + len(new)])
                self.used += len(new)
            total += n[at : at + KEPT].astype(np.float32) @ self.vectors[self.row[part]].astype(np.float32)
        return total


_TRIGRAMS: list[Trigrams] = []


def _trigrams() -> Trigrams:
    if not _TRIGRAMS:
        _TRIGRAMS.append(Trigrams())
    return _TRIGRAMS[0]


def prototypes(train: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes from all rows of ``train`` that have both columns.

    What reaches the driver is one vector a language.
    """

    def sums(batches):
        t, by_lang = _trigrams(), {}
        for b in batches:
            for x, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes, n = t.counts(x)
                if name not in by_lang:
                    by_lang[name] = np.zeros(LETTERS**3, np.int64)
                by_lang[name][codes] += n
        names = list(by_lang)
        vectors = []
        for name in names:
            codes = np.flatnonzero(by_lang[name])
            vectors.append(t.bundle(codes, by_lang[name][codes]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))], ["lang", "v"])

    known = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    rows = (
        known.mapInArrow(sums, "lang string, v array<double>")
        .select("lang", F.posexplode("v").alias("i", "x"))
        .groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        .collect()
    )
    rows = sorted((r["lang"], [x["x"] for x in r["v"]]) for r in rows)
    matrix = np.array([v for _, v in rows], np.float64).reshape(len(rows), DIM)
    norm = np.linalg.norm(matrix, axis=1)
    usable = norm > 0
    return [name for (name, _), ok in zip(rows, usable) if ok], matrix[usable] / norm[usable, None]


def identify(docs: DataFrame, names: list[str], protos: np.ndarray, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``lang_pred`` and ``score``, the cosine cut to 0..1."""

    def predict(batches):
        t = _trigrams()
        for b in batches:
            langs, scores = [], []
            for x in b.column(0).to_pylist():
                codes, n = t.counts(x) if x and names else ((), ())
                v = t.bundle(codes, n) if len(codes) else None
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cos = protos @ v / (np.linalg.norm(v) or 1.0)  # a bundle that cancels out is like none
                best = int(np.argmax(cos))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[1:], "lang_pred", "score"])

    source = docs.select(F.col(text).alias(fresh(keep, "__text")), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(predict, f"{fields}, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    names, protos = prototypes(docs.where(~F.col("held_out")))
    return identify(docs, names, protos, keep=["doc_id", "held_out"])
