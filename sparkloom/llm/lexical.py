"""Ranked lexical search over shards of compressed postings.

``build`` writes an index of whole texts: a task cuts its documents into shards of at
most ``POSTINGS`` postings (or one longer document) and writes for each shard its
documents in ascending order of doc_id with their lengths, and for each of its terms a
list of (document, occurrences), as variable-length differences.  Nothing is shuffled.

``search`` weighs the asked terms by their frequency over all shards, brings the lists
of a shard and a block of items together, and goes through them document at a time: a
heap holds the next document of each list, equal documents are taken off together, and
a bounded heap keeps the best.  Lists that cannot lift a document into that heap any
more leave the merge and are only looked up.  A window over the bests of all shards
ends it.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z
are lower-cased.  Defined results: null and empty texts have no terms and are not
counted in N.  Rows with one item_id (null included) are one item with the terms of all
its rows.  Every row is a document: repeated ids are ranked side by side, rows without
an id after all others of their score.  Items without a known term, and all items over
an empty table, give no row.  Only the named columns are read, so others may clash.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import BROADCAST_BYTES, discarded, parts, read, shared_dir, spread_join, stored

#: Postings of a shard at most (a document is never split), and items searched together.
POSTINGS, ITEMS = 1 << 21, 1024
#: Documents returned for an item.
TOP = 10

_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = "shard long, term string, n long, total long, data binary"


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in their order."""
    return (text or b"").translate(_BYTES).split()


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values from 0 as bytes, seven bits each, low ones first; and where each one ends."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    at, left = ends - size, np.arange(len(v))
    for k in range(10):
        left = left[size[left] > k]
        if not len(left):
            break
        out[at[left] + k] = (v[left] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(size[left] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def decode(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(b < 128)[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first).astype(np.int64)


class Shard:
    """Documents gathered by a task until their postings fill a shard."""

    def __init__(self) -> None:
        self.vocabulary = defaultdict(lambda: len(self.vocabulary))
        self.ids, self.lengths, self.found, self.postings = [], [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = terms(text)
        numbers = np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))
        self.found.append(np.unique(numbers, return_counts=True))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.postings += len(self.found[-1][0])

    def batches(self, shard: int):
        """Rows of INDEX: the documents (without a term), then a list for each term."""
        known = np.array([x is not None for x in self.ids], bool)
        ids = np.array([x or 0 for x in self.ids], np.int64)
        order = np.lexsort((ids, ~known))
        steps = np.diff(ids[order][known[order]], prepend=0)
        low = int(ids[order][0]) if known.any() else 0
        if len(steps):
            steps[0] = 0
        head = np.concatenate([[int(known.sum()), low & (1 << 32) - 1, low >> 32 & (1 << 32) - 1], steps, np.array(self.lengths, np.int64)[order]])
        yield self._batch(shard, [None], [sum(n > 0 for n in self.lengths)], [sum(self.lengths)], pa.array([encode(head)[0].tobytes()]))
        if not self.vocabulary:
            return
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc = np.repeat(rank, [len(t) for t, _ in self.found])
        term = np.concatenate([t for t, _ in self.found]).astype(np.int64)
        times = np.concatenate([n for _, n in self.found])
        by = np.argsort(term * len(rank) + doc)
        doc, times, sizes = doc[by], times[by], np.bincount(term, minlength=len(self.vocabulary))
        first = np.cumsum(sizes) - sizes
        steps = np.diff(doc, prepend=0)
        steps[first] = doc[first]
        pairs = np.empty(2 * len(doc), np.int64)
        pairs[0::2], pairs[1::2] = steps, times
        data, ends = encode(pairs)
        offsets = np.concatenate([[0], ends[2 * (first + sizes) - 1]])
        totals, names = np.add.reduceat(times, first), list(self.vocabulary)
        for at in range(0, len(names), 10_000):
            part = slice(at, at + 10_000)
            cut = offsets[at : at + 10_001]
            blob = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut - cut[0]).astype(np.int32).tobytes()), pa.py_buffer(data[cut[0] : cut[-1]].tobytes())])
            yield self._batch(shard, names[part], sizes[part], totals[part], blob)

    @staticmethod
    def _batch(shard, names, n, totals, data):
        columns = [pa.array([shard] * len(names), pa.int64()), pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array(totals, pa.int64()), data.cast(pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["shard", "term", "n", "total", "data"])


def documents(data: bytes) -> tuple[list, np.ndarray]:
    """Ids (None for those without) and lengths of a shard's documents."""
    v = decode(data)
    known, low = int(v[0]), int(v[1]) | int(v[2]) << 32
    low -= (low >> 63) << 64
    lengths = v[3 + known :]
    return (low + np.cumsum(v[3 : 3 + known])).tolist() + [None] * (len(lengths) - known), lengths


def build(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all rows of ``docs``, written to the fresh folder ``path``."""

    def shards(batches):
        made, shard = TaskContext.get().partitionId() << 24, Shard()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                shard.add(i, t.as_py())
                if shard.postings >= POSTINGS:
                    yield from shard.batches(made)
                    made, shard = made + 1, Shard()
        if shard.ids:
            yield from shard.batches(made)

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary"))
    index = rows.mapInArrow(shards, INDEX.replace("term string", "term binary")).withColumn("term", F.col("term").cast("string"))
    index.write.parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def wanted(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``item`` and ``term``."""
    kind = items.schema[item_id].dataType

    def cut(batches):
        for b in batches:
            pairs = [(i, t) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in set(terms(x))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], b.column(0).type), pa.array([t for _, t in pairs], pa.binary())], ["item", "term"])

    found = items.select(F.col(item_id).alias("item"), F.col(text).cast("binary")).mapInArrow(cut, f"item {kind.simpleString()}, term binary")
    return found.select("item", F.col("term").cast("string").alias("term")).distinct()


def best(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, int]]:
    """At most ``k`` (score, place) of documents with the highest sums above 0 over lists of
    ascending places and what each adds; of equal sums the earlier place stays.

    The heap has one number for each list in the merge: its next place, then the list.
    """
    lists = sorted(((p, a) for p, a in lists if len(p)), key=lambda x: int(x[1].max()))
    bits = max(1, len(lists).bit_length())
    mask, bounds = (1 << bits) - 1, np.cumsum([0, *(int(a.max()) for _, a in lists)]).tolist()
    keys = [((p.astype(np.int64) << bits) + t).tolist() for t, (p, _) in enumerate(lists)]
    adds, at, heap = [a.tolist() for _, a in lists], [0] * len(lists), [x[0] for x in keys]
    heapify(heap)
    kept: list[tuple[int, int]] = []
    bar, aside = 0, 0  # lists below ``aside`` have left the merge
    while heap:
        place, score = heap[0] >> bits, 0
        while heap and heap[0] >> bits == place:
            t = heap[0] & mask
            score += adds[t][at[t]]
            at[t] += 1
            if at[t] < len(keys[t]):
                heapreplace(heap, keys[t][at[t]])
            else:
                heappop(heap)
        for t in range(aside - 1, -1, -1):
            if score + bounds[t + 1] <= bar:
                break
            key = place << bits | t
            at[t] = bisect_left(keys[t], key, at[t])
            if at[t] < len(keys[t]) and keys[t][at[t]] == key:
                score += adds[t][at[t]]
        if score > bar:
            (heappush if len(kept) < k else heapreplace)(kept, (score, -place))
            if len(kept) == k and kept[0][0] > bar:
                bar, before = kept[0][0], aside
                while aside < len(lists) and bounds[aside + 1] <= bar:
                    aside += 1
                if aside > before:
                    heap = [x for x in heap if x & mask >= aside]
                    heapify(heap)
    return [(s, -p) for s, p in kept]


def weight(n: Column, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double")))


def search(index: DataFrame, items: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the ``k`` best documents of each item."""
    spark = index.sparkSession
    asked = wanted(items, item_id, text)
    kind = asked.schema["item"].dataType.simpleString()
    size = asked.agg(F.countDistinct("item").alias("items"), F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("term")).alias("bytes")).first()
    heads = index.where(F.col("term").isNull())
    all_n, all_terms = (int(x or 0) for x in heads.agg(F.sum("n"), F.sum("total")).first())
    few = (size["bytes"] or 0) + 64 * size["rows"] <= BROADCAST_BYTES
    names = asked.select("term").distinct()
    counts = index.select("term", "n").join(F.broadcast(names) if few else names, "term").groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("uses"))
    blocks = max(1, math.ceil((size["items"] or 0) / ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
    weighed = asked.join(counts, "term").select("term", "item", "uses", block, weight(F.lit(all_n), F.col("df")).alias("w")).where("w > 0")
    wants = weighed.groupBy("term", "block").agg(F.first("w").alias("w"), F.first("uses").alias("uses"), F.collect_list(F.struct("item")).alias("items"))
    rows = index.select("shard", "term", "n", "data")
    if few:
        lists = rows.join(F.broadcast(wants), "term")
    else:
        lists = spread_join(rows, wants, "term", "uses", "shard", counts=counts)
    lists = lists.select("shard", "block", "w", "items", "data")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    heads = heads.select("shard", every, F.lit(None).cast("long").alias("w"), F.lit(None).cast(lists.schema["items"].dataType).alias("items"), "data")

    def ranked(group: pa.Table) -> pa.Table:
        w, asking, data = (group.column(c).to_pylist() for c in ("w", "items", "data"))
        ids, lengths = documents(data[w.index(None)])
        m = 10 + (90 * lengths * all_n) // max(1, all_terms)
        of, lists = defaultdict(list), []
        for weight_, who, blob in zip(w, asking, data):
            if weight_ is not None:
                v = decode(blob)
                place, times = np.cumsum(v[0::2]), v[1::2]
                lists.append((place, weight_ * (1_000_000_000 * times // (1000 * times + 8 * m[place]))))
                for x in who:
                    of[x["item"]].append(len(lists) - 1)
        found = [(i, ids[p], s) for i, mine in of.items() for s, p in best([lists[x] for x in mine], k)]
        columns = [pa.array([x[j] for x in found], t) for j, t in enumerate((group.schema.field("items").type.value_type.field(0).type, pa.int64(), pa.int64()))]
        return pa.Table.from_arrays(columns, ["item", "doc_id", "score"])

    dealt = lists.unionByName(heads).repartition(parts(spark), "shard", "block")  # by work, not by bytes
    found = dealt.groupBy("shard", "block").applyInArrow(ranked, f"item {kind}, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("item").alias(item_id), "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    index = build(read(spark, sf_dir, "documents"), path)
    found = stored(search(index, read(spark, sf_dir, "benchmark")), "found")
    discarded(spark, path)
    return found


OP12_SQL = r"""
WITH cut AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents
), lengths AS (SELECT r, doc_id, len(t) AS n FROM cut WHERE len(t) > 0),
alls AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), words AS (SELECT r, unnest(t) AS term FROM cut),
postings AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * (SELECT big_n FROM alls) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings GROUP BY term),
scores AS (
    SELECT a.item_id, l.r, any_value(l.doc_id) AS doc_id,
        sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * l.n * (SELECT big_n FROM alls)) // (SELECT big_l FROM alls)))))::BIGINT AS score
    FROM asked a JOIN postings p USING (term) JOIN weights w USING (term) JOIN lengths l USING (r)
    GROUP BY a.item_id, l.r
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
