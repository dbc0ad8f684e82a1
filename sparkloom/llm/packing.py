"""Packing token streams into fixed sequences by cutting-stock column generation.

A document's ids are cut into whole sequences and one rest.  The histogram of rest
lengths (at most ``length - 1`` bins, whatever the corpus) is the demand of a
cutting-stock problem: a linear program over patterns of rests that fit a sequence, in
which a knapsack dynamic program prices new patterns until none is worth more than its
sequence.  The rounded number of each pattern is assigned to documents by their rank
among the rests of equal length.  Rests that rounding leaves over are priced into whole
patterns again; the few that fit none are laid end to end through the gaps of patterns
that are not full and through sequences of their own, and cut there.  The last of these
is cut into sizes that are powers of two, which need no padding.

Ranks come from counters within input partitions plus sums over earlier partitions, so
no length, however common, meets in one task.

Defined results: null text counts as empty, and an empty text has its end id alone.
Repeated rows are packed as often as they occur.  An empty table gives no rows.  Only
the id and text columns are read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import read, shared_dir, small
from .tokens import encoder

#: A pattern is worth a place in the basis if its lengths' duals pass one by this much.
#: Columns are generated until the levels are within this part of a proven bound, or so
#: many sequences; the share of the basis' own duals in the smoothed ones; a guard against
#: going round, which no table here has come near.
WORTH, GAP, LEAST, SMOOTH, GUARD = 1e-9, 0.02, 3.0, 0.05, 20_000


def best_pattern(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of lengths within the capacity, by dynamic programming."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = ends[c]
        best[c] = best[c - 1]
        if k:
            got = values[:k] + best[c - lengths[:k]]
            i = int(np.argmax(got))
            if got[i] > best[c] + 1e-12:
                best[c], take[c] = got[i], i
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= lengths[take[c]]
    return best[capacity], pattern


def fullest_pattern(lengths: np.ndarray, copies: np.ndarray, first: int, capacity: int) -> np.ndarray:
    """The multiset with ``first`` (and at most so many ``copies`` of each length) that fills
    most of the capacity, long lengths before short ones: a knapsack whose values are the
    lengths, as the duals are where nothing is wasted.  Sets of sums are bits of integers."""
    room, every = capacity - int(lengths[first]), (1 << capacity + 1) - 1
    usable = [i for i in np.flatnonzero(copies).tolist() if lengths[i] <= room]
    sums, now = [], 1
    for i in usable:
        sums.append(now)
        n = int(lengths[i])
        for _ in range(min(int(copies[i]) - (i == first), room // n)):
            more = (now | now << n) & every
            if more == now:
                break
            now = more
    left = (now & (1 << room + 1) - 1).bit_length() - 1
    pattern = np.zeros(len(lengths), np.int64)
    pattern[first] = 1
    for i, below in zip(reversed(usable), reversed(sums)):
        n, most = int(lengths[i]), int(copies[i]) - (i == first)
        k = min(most, left // n)
        while k >= 0 and not below >> (left - k * n) & 1:  # the rest must be reachable by shorter ones
            k -= 1
        pattern[i] += k
        left -= k * n
    return pattern


def _first_basis(lengths: np.ndarray, need: np.ndarray, capacity: int) -> np.ndarray:
    """A triangular basis (columns by the length that each uses up): the longest length left
    is filled up as far as possible, and used as often as the scarcest length of it allows."""
    columns, left, done = np.zeros((len(lengths), len(lengths)), np.int64), need.astype(np.float64), np.zeros(len(lengths), bool)
    for _ in range(len(lengths)):
        first = int(np.flatnonzero(~done)[-1])
        copies = np.where(done, 0, np.maximum(np.floor(left + 1e-9), 1)).astype(np.int64)
        pattern = fullest_pattern(lengths, copies, first, capacity)
        ratio = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        out = int(np.argmin(ratio))
        left = np.maximum(left - ratio[out] * pattern, 0)
        columns[:, out], done[out] = pattern, True
    return columns


def solved(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Columns and levels of a basis of the covering program, and a proven lower bound on the
    number of sequences that they come close to (within ``GAP``).

    The revised simplex method keeps the inverse of the basis; duals price lengths.  Duals
    are smoothed towards lengths over capacity, which are feasible, so a pattern that wastes
    nothing is preferred; any duals over their best pattern's value prove a bound.
    """
    columns, even = _first_basis(lengths, need, capacity), lengths / capacity
    inverse = np.linalg.inv(columns.astype(np.float64))
    x, bound, share = np.maximum(inverse @ need, 0), float(even @ need), SMOOTH
    for _ in range(GUARD):
        if x.sum() <= bound + max(LEAST, GAP * bound):
            break
        duals = inverse.sum(axis=0)
        mixed = np.maximum(share * duals + (1 - share) * even, 0)
        value, pattern = best_pattern(lengths, mixed, capacity)
        bound = max(bound, float(mixed @ need) / max(value, 1e-12))
        if duals @ pattern <= 1 + WORTH:
            if share == 1:
                break  # no pattern is worth more than its sequence
            share = min(1.0, 2 * share)
            continue
        share = SMOOTH
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        ties = np.flatnonzero(ratio <= ratio.min() + 1e-9)
        out = int(ties[np.argmax(step[ties])])  # the largest step keeps the inverse exact
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = pattern
    return columns, x, bound


def patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often to use each, within the demand; full ones first.

    The optimal levels are rounded down; what is left is priced again, as whole patterns,
    as long as one can be filled up.  Patterns that stay short come last.
    """
    lengths = np.array(sorted(demand), np.int64)
    if not len(lengths):
        return []
    left, used = np.array([demand[x] for x in lengths.tolist()], np.int64), []
    columns, x, _ = solved(lengths, left.astype(np.float64), capacity)
    fill = lengths @ columns

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        some = pattern > 0  # never empty: every column has its own length
        times = min(times, int((left[some] // pattern[some]).min()))
        if times > 0:
            used.append(({int(n): int(c) for n, c in zip(lengths[some], pattern[some])}, times))
            left = left - times * pattern

    for p in np.flatnonzero(fill == capacity).tolist():
        use(columns[:, p], int(np.floor(x[p] + 1e-6)))
    for first in reversed(range(len(lengths))):
        while left[first]:
            pattern = fullest_pattern(lengths, left, first, capacity)
            if lengths @ pattern < capacity:
                break
            use(pattern, int(left.max()))
    for p in sorted(np.flatnonzero(fill < capacity).tolist(), key=lambda p: -fill[p]):
        use(columns[:, p], int(np.floor(x[p] + 1e-6)))
    return used


class Plan:
    """Where each rest goes: for (length, rank) the sequence and offset of its pieces.

    Rests of patterns stay whole.  The others are laid end to end: first through the gaps
    of patterns that are not full, of which only so many are used as can be filled, then
    through sequences of their own.
    """

    def __init__(self, demand: dict[int, int], capacity: int) -> None:
        self.capacity, self.slots, taken, sequence = capacity, {}, dict.fromkeys(demand, 0), 0
        spare, gaps = sum(n * k for n, k in demand.items()), []  # tokens not in patterns; (first sequence, times, offset)
        for pattern, times in patterns(demand, capacity):
            filled = sum(n * c for n, c in pattern.items())
            if filled < capacity:  # what is laid end to end must reach for all gaps
                times = min(times, (spare - sum(t * (capacity - o) for _, t, o in gaps)) // capacity)
            if times <= 0:
                continue
            spare -= filled * times
            offset = 0
            for length, count in sorted(pattern.items(), reverse=True):
                for _ in range(count):
                    self.slots.setdefault(length, []).append((taken[length], sequence, offset))
                    taken[length] += times
                    offset += length
            if filled < capacity:
                gaps.append((sequence, times, offset))
            sequence += times
        self.taken, self.lay, at = taken, {}, 0
        for length in sorted(demand, reverse=True):
            self.lay[length] = at
            at += length * (demand[length] - taken[length])
        #: Stretches of what is laid: (begin, size of each part, first sequence, offset there).
        self.runs, begin = [], 0
        for first, times, offset in gaps:
            self.runs.append((begin, capacity - offset, first, offset))
            begin += times * (capacity - offset)
        whole, tail = divmod(at - begin, capacity)
        self.runs.append((begin, capacity, sequence, 0))
        begin, sequence = begin + whole * capacity, sequence + whole
        for k in reversed(range(capacity.bit_length())):  # the tail is cut into powers of two
            if tail >> k & 1:
                self.runs.append((begin, 1 << k, sequence, 0))
                begin, sequence = begin + (1 << k), sequence + 1
        self.sequences = sequence

    @property
    def whole(self) -> int:
        """Rests that patterns keep whole."""
        return sum(self.taken.values())

    def pieces(self, length: int, rank: int):
        """``(start, length, sequence, offset)`` of the pieces of one rest."""
        if rank < self.taken[length]:
            slots = self.slots[length]
            lo, sequence, offset = slots[bisect.bisect_right(slots, (rank, 1 << 62)) - 1]
            yield 0, length, sequence + rank - lo, offset
            return
        at = self.lay[length] + (rank - self.taken[length]) * length
        end, start = at + length, at
        while at < end:
            begin, size, first, offset = self.runs[bisect.bisect_right(self.runs, (at, 1 << 62)) - 1]
            nth, within = divmod(at - begin, size)
            stop = min(end, at + size - within)
            yield at - start, stop - at, first + nth, offset + within
            at = stop


def _encoded(docs: DataFrame, doc_id: str, text: str, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """Every document's ids with counters of its partition, which ``pack`` turns into ranks."""

    def encode(batches):
        enc, block, rests, wholes = encoder(tokenizer), TaskContext.get().partitionId(), {}, 0
        last = np.array([end], np.uint16)
        for b in batches:
            rows = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                ids = np.concatenate([enc.one(t or ""), last])
                whole, rest = divmod(len(ids), capacity)
                rank = rests.get(rest, 0)
                rests[rest] = rank + 1
                for column, v in zip(rows, (len(ids), rest, rank, wholes, block, ids.tobytes())):
                    column.append(v)
                wholes += whole
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            names = ["doc_id", "n", "rest", "rank", "wholes", "block", "ids"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds))], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(encode, "doc_id long, n long, rest int, rank long, wholes long, block int, ids binary")


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids"
    encoded = _encoded(docs, doc_id, text, tokenizer, end, capacity)
    encoded.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(encoded.schema).parquet(path)

    counts = table.where("rest > 0").groupBy("block", "rest").agg(F.count("*").alias("k"))
    demand = {r["rest"]: r["k"] for r in counts.groupBy("rest").agg(F.sum("k").alias("k")).collect()}
    plan = Plan(demand, capacity)
    before = F.sum("k").over(Window.partitionBy("rest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = (
        counts.withColumn("base", F.coalesce(before, F.lit(0)))
        .groupBy(F.col("block").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("rest", "base"))).alias("bases"))
    )
    blocks = table.select(F.max("block")).first()[0]
    ranked = table.join(small(bases, (blocks or 0) + 1, 20 * capacity), F.col("block") == F.col("b"), "left")
    ranked = ranked.withColumn("rank", F.col("rank") + F.coalesce(F.element_at("bases", F.col("rest")), F.lit(0)))

    def assign(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for d, n, rest, rank, wholes, block, ids in zip(*(c.to_pylist() for c in b.columns)):
                data = np.frombuffer(ids, np.uint16).astype("<u4")
                places = [(k * capacity, capacity, plan.sequences + (block << 36) + wholes + k, 0) for k in range(n // capacity)]
                if rest:
                    places += [(n - rest + s, size, seq, off) for s, size, seq, off in plan.pieces(rest, rank)]
                for start, size, seq, off in places:
                    crc = zlib.crc32(data[start : start + size].tobytes())
                    for column, v in zip(out, (d, start, size, crc, n, seq, off)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    columns = ["doc_id", "n", "rest", "rank", "wholes", "block", "ids"]
    return ranked.select(*columns).mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
