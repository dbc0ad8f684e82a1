"""A stored index for nearest vectors, approximate or exact, with filters.

``build`` fits two levels of centres and a product quantiser to a bounded sample, then puts
every row into the list of its nearest fine centre, with its residual as a code of one byte
for each two dimensions, the error that the code makes and its distance to the centre.
The rows are stored bucketed by slot (a list, or a part of a large one), so a search shuffles
queries only.

``search`` reads the codes of the nearest lists by tables of distances and scores the best
few rows exactly.  ``exact`` starts from its result: the k-th distance closes every list whose
centre is farther than that and the list's radius, and, by the triangle inequality, every row
whose code lies farther than that and the code's error; only what is left is scored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import vectors
from ..session import scratch, small, stored
from .search import top

#: Rows that centres and codes are fitted to (in expectation), lists at most, rounds of k-means, seed.
SAMPLE, MOST, ROUNDS, SEED = 20_000, 4096, 8, 20240619
#: Dimensions to a byte of code, and nearest coarse centres in which a row's list is sought.
STEP, COARSE = 2, 3
#: Part of the lists whose codes a query reads, so many at least; rows scored for each one asked for.
#: The test vectors hardly cluster: on clustered ones a far smaller part would do.
PROBES, LEAST, AGAIN = 0.8, 8, 4
#: Rows of a slot (in expectation), queries whose tables are held at once.
SLOT, TABLES = 50_000, 128
#: Distances of rows to lists, and pairs of a query and a slot, that are held at once.
CELLS, PAIRS = 1 << 20, 1 << 15
#: Room for rounding in squared distances of unit vectors.
SLACK = 1e-5


@dataclass
class Model:
    """Fine centres, ordered by the coarse one that each belongs to, and the codes' centres
    (place, byte, dimension).  ``parts`` tells into how many slots a list is cut, ``first`` its first."""

    coarse: np.ndarray
    owner: np.ndarray
    fine: np.ndarray
    codes: np.ndarray
    parts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.parts) - self.parts

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``x`` by place of the code."""
        places, _, width = self.codes.shape
        return np.pad(x, ((0, 0), (0, places * width - x.shape[1]))).reshape(len(x), places, width)

    def nearest_lists(self, x: np.ndarray, coarse: int, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row, among those of its nearest ``coarse`` centres and
        further ones if these have too few."""
        far = _distances(x, self.coarse)
        order = np.argsort(far, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        sizes = np.bincount(self.owner, minlength=len(self.coarse))
        need = np.argmax(np.cumsum(sizes[order], axis=1) >= n, axis=1)
        d = _distances(x, self.fine)
        d[rank[:, self.owner] > np.maximum(need, coarse - 1)[:, None]] = np.inf
        return np.argsort(d, axis=1, kind="stable")[:, :n]


@dataclass
class Index:
    """``rows`` (slot, dist, error, code, key, vector, and columns that filters may name), the
    model, and rows and radius of each slot."""

    rows: DataFrame
    model: Model
    sizes: np.ndarray
    radius: np.ndarray
    key: str
    vector: str
    table: str


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows along unit vectors; a zero vector counts as the first axis."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    axis = np.zeros_like(x)
    axis[:, :1] = 1
    return np.where(size > 0, x / np.where(size > 0, size, 1), axis)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``k`` centres of the rows."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmin(_distances(x, c), axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, max(1, rows)):
            yield b.slice(at, max(1, rows))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def fitted(corpus: DataFrame, key: str, vector: str, lists: int | None = None) -> Model | None:
    """The model of a sample drawn by a hash of the key, whose size does not grow with the corpus;
    None without rows."""
    n = corpus.count()
    every = max(1, n // SAMPLE)
    rows = corpus.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(key, F.col(vector).cast("array<double>").alias("v")).where("v is not null").orderBy(key).collect()
    if not rows:
        return None
    x, rng = _unit(np.array([r["v"] for r in rows])), np.random.default_rng(SEED)
    lists = min(MOST, len(x), lists or max(1, round(math.sqrt(n))))
    coarse = _means(x, max(1, round(math.sqrt(lists))), rng)
    own = np.argmin(_distances(x, coarse), axis=1)
    fine, owner = [], []
    for c in range(len(coarse)):
        mine = x[own == c] if (own == c).any() else coarse[c : c + 1]
        fine.append(_means(mine, max(1, round(lists * len(mine) / len(x))), rng))
        owner += [c] * len(fine[-1])
    model = Model(coarse, np.array(owner), np.concatenate(fine), np.zeros((-(-x.shape[1] // STEP), 1, STEP)), np.ones(len(owner), np.int64))
    near = model.nearest_lists(x, COARSE, 1)[:, 0]
    rest = model.cut(x - model.fine[near])
    model.codes = np.zeros((rest.shape[1], min(256, len(x)), STEP))
    for m in range(rest.shape[1]):
        model.codes[m] = _means(rest[:, m], 256, rng)
    share = np.bincount(near, minlength=len(owner)) / len(x)
    model.parts = np.maximum(1, np.ceil(share * n / SLOT)).astype(np.int64)
    return model


def build(corpus: DataFrame, key: str = "id", vector: str = "embedding", carry: tuple[str, ...] = (), lists: int | None = None) -> Index | None:
    """The index of all rows that have a vector, in a table of its own under the session's shared
    folder; ``carry`` names columns for filters."""
    model = fitted(corpus, key, vector, lists)
    if model is None:
        return None
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded: MOST centres and 256 for each place of a code
    rows = corpus.where(F.col(vector).isNotNull()).select(key, vector, *carry, F.xxhash64(key).alias("__hash"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in _cut(batches, CELLS // len(m.fine)):
            x = _unit(_matrix(b.column(1)))
            near = m.nearest_lists(x, COARSE, 1)[:, 0]
            rest = m.cut(x - m.fine[near])
            code = np.stack([np.argmin(_distances(rest[:, i], m.codes[i]), axis=1) for i in range(rest.shape[1])], axis=1)
            wrong = np.sqrt(((rest - m.codes[np.arange(rest.shape[1]), code]) ** 2).sum((1, 2)))
            slot = m.first[near] + b.column(b.num_columns - 1).to_numpy() % m.parts[near]
            made = [pa.array(slot.astype(np.int32)), pa.array(np.sqrt((rest**2).sum((1, 2)))), pa.array(wrong), pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*made, *b.columns[:-1]], ["slot", "dist", "error", "code", *b.schema.names[:-1]])

    done = rows.mapInArrow(coded, f"slot int, dist double, error double, code binary, {fields}")
    path = scratch(spark, "vectors")
    name, buckets = "sparkloom_" + path.rpartition("-")[2], int(min(model.parts.sum(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    done.repartition(buckets, "slot").write.format("parquet").option("path", path).bucketBy(buckets, "slot").sortBy("slot").saveAsTable(name)
    held = spark.table(name)
    sizes, radius = np.zeros(int(model.parts.sum()), np.int64), np.zeros(int(model.parts.sum()))
    for r in held.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect():  # a row for each slot
        sizes[r["slot"]], radius[r["slot"]] = r["n"], r["r"]
    return Index(held, model, sizes, radius, key, vector, name)


def dropped(index: Index) -> None:
    """The index's table is gone from the catalog; its files stay until the shared folder is cleared."""
    index.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {index.table}")


def _asked(index: Index, queries: DataFrame, slots: Callable) -> DataFrame:
    """A row of ``queries`` (``query_id``, ``query_vector``, ``reach``) for each slot that ``slots``
    (of unit vectors and reaches, a mask of slots for each) names, with the unit vector."""
    shared = queries.sparkSession.sparkContext.broadcast((index.model, index.radius))
    kind = queries.schema["query_id"].dataType.simpleString()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches, CELLS // len(shared.value[1])):
            x, reach = _unit(_matrix(b.column(1))), b.column(2).to_numpy()
            whose, where = np.nonzero(slots(*shared.value, x, reach))
            for at in range(0, len(whose), PAIRS):
                who, slot = whose[at : at + PAIRS], where[at : at + PAIRS]
                unit = pa.ListArray.from_arrays(np.arange(len(who) + 1, dtype=np.int32) * x.shape[1], x[who].ravel())
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), b.column(0).take(pa.array(who)), unit, pa.array(reach[who])], ["slot", "query_id", "unit", "reach"])

    rows = queries.where(F.col("query_vector").isNotNull()).select("query_id", "query_vector", "reach")
    return rows.mapInArrow(opened, f"slot int, query_id {kind}, unit array<double>, reach double")


def _read(index: Index, rows: DataFrame, asked: DataFrame, chosen: Callable) -> DataFrame:
    """``query_id``, key, ``slot``, ``far``: what ``chosen`` keeps of a slot's rows for a query, by
    squared distances to their codes, distances to the centre and errors."""
    shared, key = rows.sparkSession.sparkContext.broadcast(index.model), index.key
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (rows, key))]

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        m, found, names = shared.value, [], ["query_id", key, "slot", "far"]
        if left.num_rows and right.num_rows:
            slot = left.column("slot")[0].as_py()
            centre = m.fine[np.searchsorted(m.first, slot, side="right") - 1]
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            dist, error = left.column("dist").to_numpy(), left.column("error").to_numpy()
            for at in range(0, right.num_rows, TABLES):
                part = right.slice(at, TABLES)
                rest = _matrix(part.column("unit").combine_chunks()) - centre
                tables = ((m.cut(rest)[:, :, None, :] - m.codes[None]) ** 2).sum(3)
                far = np.zeros((part.num_rows, left.num_rows))
                for i in range(code.shape[1]):
                    far += tables[:, i, code[:, i]]
                own = np.sqrt((rest**2).sum(1))
                for q, reach in enumerate(part.column("reach").to_pylist()):
                    rows_of = chosen(far[q], dist, error, own[q], reach)
                    who = part.column("query_id").slice(q, 1).take(pa.array(np.zeros(len(rows_of), np.int64)))
                    found.append(pa.Table.from_arrays([who, left.column(key).take(pa.array(rows_of)), pa.array(np.full(len(rows_of), slot, np.int32)), pa.array(far[q][rows_of])], names))
        schema = pa.schema(list(zip(names, (right.schema.field("query_id").type, left.schema.field(key).type, pa.int32(), pa.float64()))))
        return pa.concat_tables(found).cast(schema) if found else schema.empty_table()

    codes = rows.select("slot", "dist", "error", "code", key)
    return codes.groupBy("slot").cogroup(asked.groupBy("slot")).applyInArrow(met, f"query_id {kinds[0]}, `{key}` {kinds[1]}, slot int, far double")


def _scored(index: Index, rows: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact cosines of the pairs in ``found``."""
    found = small(found.select("query_id", index.key, "slot"), 64)
    asked = stored(queries.select("query_id", vectors.normalized(F.col("query_vector")).alias("__q")), "asked")
    pairs = rows.select("slot", index.key, F.col(index.vector).alias("__v")).join(found, ["slot", index.key]).join(small(asked, 1024), "query_id")
    size = vectors.norm(F.col("__v"))
    cosine = F.when(size == 0, F.element_at("__q", 1)).otherwise(vectors.dot(F.col("__v"), F.col("__q")) / size)
    return stored(pairs.select("query_id", index.key, cosine.alias("score")), "scores")


def candidates(index: Index, queries: DataFrame, k: int = 10, where: Column | str | None = None, probes: float = PROBES, again: int = AGAIN) -> DataFrame:
    """The ``again * k`` rows nearest by code in the probed lists, after the filter, stored."""
    rows = index.rows if where is None else index.rows.where(where)
    n = min(len(index.model.fine), max(LEAST, math.ceil(probes * len(index.model.fine))))

    def nearest(model: Model, radius: np.ndarray, x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        mask = np.zeros((len(x), len(model.fine)), bool)
        np.put_along_axis(mask, model.nearest_lists(x, COARSE, n), True, axis=1)
        return np.repeat(mask, model.parts, axis=1)

    def first(far: np.ndarray, *_) -> np.ndarray:
        return np.argpartition(far, again * k - 1)[: again * k] if len(far) > again * k else np.arange(len(far))

    asked = _asked(index, queries.withColumn("reach", F.lit(0.0)), nearest)
    return stored(top(_read(index, rows, asked, first), again * k, F.col("far"), F.col(index.key)).drop("rank"), "candidates")


def _best(index: Index, found: DataFrame, queries: DataFrame, k: int, threshold: float = -1.0, metric: str = "cosine") -> DataFrame:
    """The ``k`` nearest of each query among the pairs in ``found``, scored exactly."""
    scored = _scored(index, index.rows, found, queries)
    if metric == "certainty":
        scored = scored.withColumn("score", vectors.certainty(F.col("score")))
    return top(scored.where(F.col("score") >= threshold), k, F.desc(F.round("score", 9)), F.col(index.key))


def search(index: Index, queries: DataFrame, k: int = 10, threshold: float = -1.0, where: Column | str | None = None, probes: float = PROBES, again: int = AGAIN, metric: str = "cosine") -> DataFrame:
    """``query_id``, key, ``score``, ``rank``: about the ``k`` nearest rows by cosine that pass the
    filter.  ``queries``: ``query_id``, ``query_vector``."""
    return _best(index, candidates(index, queries, k, where, probes, again), queries, k, threshold, metric)


def open_pairs(index: Index, queries: DataFrame, near: DataFrame, k: int = 10, where: Column | str | None = None) -> DataFrame:
    """Every pair that can be among a query's ``k`` nearest, stored: what the bounds leave, given
    the ``candidates``."""
    rows = index.rows if where is None else index.rows.where(where)
    kth = _best(index, near, queries, k).where(F.col("rank") == k).select("query_id", (2 - 2 * F.col("score")).alias("far"))
    reach = F.sqrt(F.greatest(F.coalesce("far", F.lit(16.0)), F.lit(0.0)) + SLACK)  # with fewer than k rows found, all are near enough
    asked = queries.select("query_id", "query_vector").join(small(kth, 32), "query_id", "left").withColumn("reach", reach)

    def lists(model: Model, radius: np.ndarray, x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        return np.repeat(np.sqrt(_distances(x, model.fine)), model.parts, axis=1) - radius <= reach[:, None] + SLACK

    def kept(far: np.ndarray, dist: np.ndarray, error: np.ndarray, own: float, reach: float) -> np.ndarray:
        return np.flatnonzero((np.abs(own - dist) <= reach) & (np.sqrt(far) - error <= reach))

    return stored(_read(index, rows, _asked(index, asked, lists), kept), "open")


def exact(index: Index, queries: DataFrame, k: int = 10, threshold: float = -1.0, where: Column | str | None = None, metric: str = "cosine") -> DataFrame:
    """As ``search``, but the very nearest rows: those of ``operators.search.nearest``."""
    found = open_pairs(index, queries, candidates(index, queries, k, where), k, where)
    return _best(index, found, queries, k, threshold, metric)


def report(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """One row on the index's work for ``queries``: rows, lists, recall of ``search``, and the parts
    of all pairs that ``search`` and ``exact`` score."""
    near = candidates(index, queries, k)
    open_ = open_pairs(index, queries, near, k)
    found = _best(index, near, queries, k).select("query_id", index.key, F.lit(1).alias("hit"))
    recall = _best(index, open_, queries, k).select("query_id", index.key).join(found, ["query_id", index.key], "left")
    recall = recall.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    n = F.lit(int(index.sizes.sum()))
    parts = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in ((near, "near"), (open_, "open"))]
    both = recall.crossJoin(F.broadcast(parts[0])).crossJoin(F.broadcast(parts[1]))  # one row each
    return both.select(n.alias("rows"), F.lit(len(index.model.fine)).alias("lists"), "queries", "recall", (F.col("near") / (n * F.col("queries"))).alias("scored"), (F.col("open") / (n * F.col("queries"))).alias("scored_exact"))
