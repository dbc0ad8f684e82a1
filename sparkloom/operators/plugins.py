"""Pluggable models: embedders and scorers as batch functions over Arrow.

A model is any function from lists of texts to arrays.  The defaults need no files: words
hashed into a vector, and word overlap.  Texts are made distinct before they are encoded,
so equal texts cost one call; the result is a table that later runs read again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

DIM = 64


def hashed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Unit vectors of signed word counts; a text without words becomes the first axis."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts):
        for w in (text or "").lower().split():
            h = zlib.crc32(w.encode())
            row[h % dim] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out[norm[:, 0] == 0, 0] = 1
    return out / np.where(norm == 0, 1, norm)


def overlap(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Share of the query's words that the text has."""
    sets = [(set((q or "").lower().split()), set((t or "").lower().split())) for q, t in pairs]
    return np.array([len(a & b) / len(a) if a else 0.0 for a, b in sets])


def encoded(rows: DataFrame, text: str = "text", embed: Callable[[list[str]], np.ndarray] = hashed, cache: DataFrame | None = None) -> DataFrame:
    """``key, embedding`` of the distinct texts (``key`` is their sha-256), without those that a
    ``cache`` table of the same form has."""
    distinct = rows.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t")).dropDuplicates(["key"])
    if cache is not None:
        distinct = distinct.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "embedding": list(embed(pdf["t"].tolist()))})

    return distinct.mapInPandas(run, "key string, embedding array<float>")


def rescored(candidates: DataFrame, query: str, text: str, score: Callable[[list[tuple[str, str]]], np.ndarray] = overlap, most: int = 100) -> DataFrame:
    """Each query's best ``most`` candidates (by ``score``) with the model's score instead."""
    from .search import top

    rows = top(candidates, most, F.desc("score"), F.col(text)).drop("rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(score=score(list(zip(pdf[query], pdf[text]))).astype(float))

    return rows.mapInPandas(run, rows.schema)
