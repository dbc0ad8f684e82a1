"""Content-defined chunks, stored once and borrowed by whoever repeats them.

A rolling gear hash over the last 32 units decides where a stream is cut, so equal
passages give equal chunks wherever they stand.  Of rows that hold a chunk with the
same digest, the smallest key owns it: its row keeps the bytes.  The others keep the
digest alone in their recipe and borrow the bytes when the store is read back.

Digests are joined and counted as rows of their own, so what moves through a shuffle is
16 bytes a chunk and, on reading, the borrowed chunks; streams stay where they were cut.
Digests that very many places hold are dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import aligned, spread_join, stored

#: Units the hash looks back on (a shift by one each), smallest and largest chunk, and
#: the mask that makes chunks about 1,024 units long beyond the smallest.
WINDOW, LEAST, MOST, MASK = 32, 256, 8192, np.uint32(0x3FF << 16)
GEAR = np.random.default_rng(20240611).integers(0, 2**32, 65536, dtype=np.uint64).astype(np.uint32)


class BrokenChunk(Exception):
    """A chunk or recipe read back does not have the digest it was stored under."""


def cuts(streams: list[np.ndarray]) -> list[list[int]]:
    """Ends of each stream's chunks.  A stream of units (uint8 or uint16) is cut by its own
    content only: the window lies inside it wherever a cut may fall."""
    if not streams:
        return []
    h = GEAR[np.concatenate(streams)]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    marks = np.flatnonzero((h & MASK) == 0) + 1
    out, start = [], 0
    for s in streams:
        ends, at = [], 0
        lo, hi = np.searchsorted(marks, [start, start + len(s)], "right")
        for m in (marks[lo:hi] - start).tolist():
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST:
                at = m
                ends.append(at)
        while len(s) - at > MOST:
            at += MOST
            ends.append(at)
        if at < len(s):
            ends.append(len(s))
        out.append(ends)
        start += len(s)
    return out


def digests(data: bytes, ends: list[int], unit: int) -> list[bytes]:
    at = [0, *ends]
    return [xxhash.xxh3_128_digest(data[a * unit : b * unit]) for a, b in zip(at, at[1:])]


def root(leaves: list[bytes]) -> bytes:
    """Merkle root: pairs are hashed level by level, an odd last node goes up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [xxhash.xxh3_128_digest(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def shares(recipes: DataFrame) -> DataFrame:
    """``key, borrowed, lent`` of the rows that share chunks, from ``key, digests``.

    ``borrowed``: places whose bytes another row (or an earlier place) keeps; ``lent``:
    own places that others need, and how many places hold them.
    """
    places = recipes.select("key", F.posexplode("digests").alias("place", "digest"))
    owner = F.min(F.struct("key", "place")).alias("owner")
    common = stored(places.groupBy("digest").agg(owner, F.count("*").alias("uses")).where("uses > 1"), "common")
    mine = (F.col("owner.key") == F.col("key")) & (F.col("owner.place") == F.col("place"))
    return (
        spread_join(places, common, "digest", "uses", "key").withColumn("mine", mine).groupBy("key")
        .agg(F.collect_list(F.when(~F.col("mine"), F.col("place"))).alias("borrowed"), F.collect_list(F.when(F.col("mine"), F.struct("place", "uses"))).alias("lent"))
    )


def with_shares(rows: DataFrame, by: str, strip: Callable, schema: str, path: str) -> DataFrame:
    """Writes the store to ``path``: ``rows`` (a table bucketed by ``by``, with ``key`` and
    ``digests``) and their ``borrowed`` and ``lent`` places (null if none), without the bytes
    that ``strip`` takes away.  Only the places are shuffled, to where their rows lie: the
    table's tasks are the join's, whatever its size."""
    spark = rows.sparkSession
    found = stored(shares(rows.select("key", "digests")).withColumn(by, F.shiftright("key", 40).cast(rows.schema[by].dataType)), "shares")
    with aligned(spark):
        rows.join(found.hint("shuffle_hash"), [by, "key"], "left").mapInArrow(strip, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def kept(data: bytes, ends: list[int], unit: int, borrowed: list[int] | None) -> bytes:
    """The bytes a row stores: its chunks without the borrowed ones."""
    if not borrowed:
        return data
    gone, at = set(borrowed), [0, *ends]
    return b"".join(data[at[i] * unit : at[i + 1] * unit] for i in range(len(ends)) if i not in gone)


def joined(body: bytes, ends: list[int], unit: int, names: list[bytes], borrowed: list[int] | None, extra: dict[int, bytes]) -> bytes:
    """The whole stream of a stored row; every chunk is checked against its digest."""
    gone, parts, used, at = set(borrowed or ()), [], 0, 0
    for i, end in enumerate(ends):
        size = (end - at) * unit
        at = end
        if i in gone:
            parts.append(extra[i])
        else:
            parts.append(body[used : used + size])
            used += size
        if xxhash.xxh3_128_digest(parts[-1]) != names[i]:
            raise BrokenChunk(f"chunk {i} of {len(ends)} has another digest")
    return b"".join(parts)


def read_back(store: DataFrame, unit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the store that hold all their chunks, and those that borrow with ``extra``,
    a list of (place, bytes).  Only borrowed chunks and borrowing rows are shuffled."""

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[bytes, bytes, int]] = []
            for body, ends, names, borrowed, lent in zip(*(c.to_pylist() for c in b.columns)):
                gone, used, at, wanted = set(borrowed or ()), 0, 0, {x["place"]: x["uses"] for x in lent}
                for i, end in enumerate(ends):
                    size = 0 if i in gone else (end - at) * unit
                    at = end
                    if i in wanted:
                        out.append((names[i], body[used : used + size], wanted[i]))
                    used += size
            kinds = (pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["digest", "chunk", "uses"])

    some = F.coalesce(F.size("borrowed"), F.lit(0)) > 0
    whole, borrowing, lending = store.where(~some), store.where(some), store.where(F.size("lent") > 0)
    lent = lending.select("body", "ends", "digests", "borrowed", "lent").mapInArrow(lend, "digest binary, chunk binary, uses long")
    counts = lending.select(F.explode("lent").alias("x"), "digests").select(F.col("digests")[F.col("x.place")].alias("digest"), "x.uses")
    wanted = borrowing.select("row", F.explode("borrowed").alias("place"), "digests").select("row", "place", F.col("digests")[F.col("place")].alias("digest"))
    extra = spread_join(wanted, lent, "digest", "uses", "row", counts=counts).groupBy("row").agg(F.collect_list(F.struct("place", "chunk")).alias("extra"))
    return whole.withColumn("extra", F.lit(None).cast("array<struct<place:int,chunk:binary>>")), borrowing.join(extra, "row")
