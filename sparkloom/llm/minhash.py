"""Near-duplicate groups with SuperMinHash.

A document's set holds the distinct runs of ``width`` words.  Every element walks
the signature's slots in its own permuted order and leaves rank + fraction in each;
a slot keeps the least.  Ranks of one element differ, so slots are negatively
correlated and the estimate has less variance than independent hashes; a document
stops once no later rank can lower any slot.  Bands of slots propose candidates,
which full sets confirm, and confirmed links are grouped by connected components.

Documents with equal sets are one node from the start.  In each bucket of a band
all nodes are first compared with the bucket's smallest node only, which is linear
in the bucket.  What those links leave apart is compared pair by pair, between
different components only and between sets whose sizes allow the similarity.  So
no link is lost that any band proposes: at similarity 0.8 the 31 bands of 5 slots
miss a pair with probability 5e-6, above it with less.

Defined results: null text, empty text and texts of white space have the empty
set, size 0, and are linked with nothing, not even each other.  With fewer than
``width`` words the whole sequence is the one element.  Rows that repeat a
document fall into one group; the smallest id stands for it.  A row without an id
joins its group but never stands for it; alone, its component is null and it is
kept.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read, small, spread_join, stored, words
from .graph import components

#: Slots of a signature (a prime: slot orders are arithmetic progressions), and bands.
SLOTS, BANDS, ROWS = 157, 31, 5
#: Elements that are signed at once.
BLOCK = 400_000
#: Longs that hold two bits of each slot, and how many slots of a candidate may differ
#: in them.  At similarity 0.8 a slot differs with probability 0.15, so 23.6 of 157 do,
#: with deviation 4.5; 52 lies over six deviations above (under 1e-9).
LONGS, DIFFER = 5, 52
#: Longs that hold the parity of the elements in each of 64 cells.  Two sets' parities
#: differ in no more cells than the sets differ in elements, so this filter loses nothing.
CELLS = 8

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (multiply and xor-shift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words."""
    w = words(text) if text else []
    if not w:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, w)), np.uint64)
    k = min(width, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = mixed(s * _M2 + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures, a row for each (nonempty) set."""
    sizes = np.array([len(s) for s in sets])
    x, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    first, step = mixed(x ^ _M1) % np.uint64(SLOTS), mixed(x ^ _M2) % np.uint64(SLOTS - 1) + np.uint64(1)
    slot, step, doc = first.astype(np.int64), step.astype(np.int64), doc.astype(np.int64)
    out = np.full(len(sets) * SLOTS, np.inf)
    rows, open_docs = out.reshape(len(sets), SLOTS), np.arange(len(sets))
    salts = np.arange(1, SLOTS + 1, dtype=np.uint64) * _M1
    for rank in range(SLOTS):
        part = (mixed(x + salts[rank]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        np.minimum.at(out, doc * SLOTS + slot, part + rank)
        still = np.zeros(len(sets), bool)
        open_docs = open_docs[rows[open_docs].max(axis=1) > rank + 1]
        if not len(open_docs):
            break
        still[open_docs] = True
        on = still[doc]
        x, slot, step, doc = x[on], slot[on], step[on], doc[on]
        slot = (slot + step) % SLOTS
    return rows


def sketched(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, bits``; ``digest`` names the set, null if empty."""

    def flush(ids, sets):
        bands, bits = [None] * len(sets), [None] * len(sets)
        full = [i for i, s in enumerate(sets) if len(s)]
        if full:
            sig = signatures([sets[i] for i in full])
            two = np.zeros((len(full), 32 * LONGS), np.uint64)
            two[:, :SLOTS] = mixed(sig.view(np.uint64)) >> np.uint64(62)
            two = (two.reshape(-1, LONGS, 32) << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=2).view(np.int64)
            for r, i in enumerate(full):
                cut = sig[r, : BANDS * ROWS].reshape(BANDS, ROWS)
                parity = np.bincount(sets[i] >> np.uint64(55), minlength=64 * CELLS).astype(np.uint8) & 1
                bits[i] = two[r].tolist() + np.packbits(parity).view(np.int64).tolist()
                bands[i] = [xxhash.xxh3_64_intdigest(cut[b].tobytes(), b) - 2**63 for b in range(BANDS)]
        digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "digest", "bands", "bits"],
        )

    def sketch(batches):
        ids, sets, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                sets.append(shingles(t, width))
                held += len(sets[-1])
                if held >= BLOCK or len(sets) >= 4000:
                    yield flush(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield flush(ids, sets)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, doc_id: str, text: str, width: int) -> DataFrame:
    """``node, items`` with the full set of each wanted document, from its whole text."""

    def full(batches):
        for b in batches:
            sets = [shingles(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else []))
            yield pa.RecordBatch.from_arrays([b.column(0), items], ["node", "items"])

    side = small(wanted.select(F.col("node").alias("__node")), n_wanted, 16)
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text")).join(side, F.col("node") == F.col("__node"), "left_semi")
    return rows.mapInArrow(full, "node long, items array<long>").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity."""
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def _alike(percent: int) -> Column:
    """Whether sizes ``na``, ``nb`` and parities allow the similarity and slots make it likely."""
    apart = F.lit(0)
    for i in range(LONGS):
        x = F.col("xa")[i].bitwiseXOR(F.col("xb")[i])
        apart += F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    unlike = F.lit(0)
    for i in range(LONGS, LONGS + CELLS):
        unlike += F.bit_count(F.col("xa")[i].bitwiseXOR(F.col("xb")[i]))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return sizes & ((100 + percent) * unlike <= (100 - percent) * (F.col("na") + F.col("nb"))) & (apart <= DIFFER)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    sketch = stored(sketched(docs, doc_id, text, width), "sketch")
    filled = sketch.where("digest is not null")
    # Of the rows of a set, that with the smallest id stands for it; map sides keep one row a
    # set, so a set that very many rows have is no more than one row from each of them.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n_shingles", "bits", "bands")))
    sets_ = filled.groupBy("digest").agg(first.alias("x"), F.count("*").alias("uses")).where("x is not null")
    nodes = stored(sets_.select("digest", "uses", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n"), F.col("x.bits").alias("x"), F.col("x.bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    pivots = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = stored(banded.join(pivots, "bucket"), "shared")
    a, b = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("x").alias(f"x{k}")) for k in "ab")

    star = shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = stored(star.join(b, "b").join(a, "a").where(_alike(percent)).select("a", "b"), "star")
    wanted = stored(shared.select("node").distinct(), "wanted")
    sets = stored(_sets(docs, wanted, wanted.count(), doc_id, text, width), "sets")
    links = stored(_confirmed(star, sets, percent), "links")
    groups = components(links)

    # Buckets that these links leave in several components: what is outside a bucket's
    # largest component is compared with all that the bucket holds of other components.
    placed = stored(
        shared.drop("pivot").join(b, F.col("node") == F.col("b")).join(groups.withColumnRenamed("node", "g"), F.col("b") == F.col("g"), "left")
        .select("bucket", "b", "nb", "xb", F.coalesce("component", "b").alias("cb")),
        "placed",
    )
    sizes = placed.groupBy("bucket", "cb").count()
    main = sizes.groupBy("bucket").agg(F.max_by("cb", F.struct("count", "cb")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    opened = stored(placed.join(main, "bucket"), "opened")
    outer = opened.where("cb <> main").select("bucket", *[F.col(f"{k}b").alias(f"{k}a") for k in "nxc"], F.col("b").alias("a"))
    other = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
    pairs = outer.join(opened, "bucket").where(other & _alike(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(pairs.distinct().join(star, ["a", "b"], "left_anti"), "rest")
    groups = components(links.union(stored(_confirmed(rest, sets, percent), "more")))

    names = stored(nodes.select("node", "digest", "uses").join(groups, "node", "left").select("digest", "uses", F.coalesce("component", "node").alias("c")), "names")
    out = spread_join(sketch.select("doc_id", "n_shingles", "digest"), names, "digest", "uses", "doc_id", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)


#: The exact answer in DuckDB: all pairs that share a shingle, and what each can reach.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)
), l AS (
  SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS b FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
