"""Vector, lexical and hybrid search, and what re-orders its results.

Result rows have ``query_id``, a key and ``score``; ties are broken by the key, so results
are the same on any cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scores, vectors
from ..session import BROADCAST_BYTES, dealt, parts, small, stored

K1, B = 1.2, 0.75
#: Rows of a part of the corpus, scores that a task holds at once.
PART, SCORES = 16_384, 1 << 20
#: Documents that a task scores.
DOCS = 1024
WORD = r"[\p{L}\p{N}_]+"


def top(rows: DataFrame, k: int, *order: Column, by: str | None = "query_id") -> DataFrame:
    """First ``k`` rows (of each ``by``) in the given order, with their ``rank``."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.7, key: str = "id", vector: str = "embedding", metric: str = "certainty") -> DataFrame:
    """The ``k`` nearest vectors of every query by cosine, exactly.

    ``queries`` has ``query_id`` and ``query_vector``.  Parts of the corpus meet blocks of queries of
    bounded size; a task multiplies the two and gives out each query's ``k`` best of the part only.
    """
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    size = queries.agg(F.sum(F.size("query_vector") * 8 + 64)).first()[0] or 0
    blocks, rows = max(1, -(-size // BROADCAST_BYTES)), corpus.count()
    parts = max(1, -(-rows // PART), min(4 * cores, -(-rows // 256)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    unit = _units(corpus, key, vector).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    asked = _units(queries, "query_id", "query_vector").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    found = _multiplied(unit, asked, ["part", "block"], key, k)
    if metric == "certainty":
        found = found.withColumn("score", vectors.certainty(F.col("score")))
    return top(found.where(F.col("score") >= threshold), k, F.desc(F.round("score", 9)), F.col(key))


def _units(rows: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """``key``, ``more``, ``dim, unit`` of the rows with a whole vector."""
    whole = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    return whole.select(key, *more, F.size(vector).alias("dim"), vectors.normalized(F.col(vector)).alias("unit"))


def _multiplied(rows: DataFrame, asked: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """``query_id``, key, ``score``: of the ``rows`` that agree with a query in ``by`` and dimension the
    ``k`` with the largest products, rounded to nine digits, ties by key."""
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (rows, key))]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[], [], []]
        if left.num_rows and right.num_rows:
            left = left.sort_by(key)
            n, dim = left.num_rows, left.column("dim")[0].as_py()
            x, y = (np.array(t.column("unit").combine_chunks().flatten(), np.float64).reshape(t.num_rows, dim) for t in (left, right))
            for at in range(0, len(y), max(1, SCORES // n)):
                part = y[at : at + max(1, SCORES // n)]
                score = part @ x.T
                # Not a number ranks first, as in an ORDER BY; then the smaller key.
                order = np.where(np.isnan(score), 2e9, np.rint(score * 1e9)).astype(np.int64) * n + np.arange(n)[::-1]
                keep = np.argpartition(-order, min(k, n) - 1, axis=1)[:, :k]
                found[0].append(np.repeat(np.arange(at, at + len(part)), keep.shape[1]))
                found[1].append(keep.ravel())
                found[2].append(np.take_along_axis(score, keep, axis=1).ravel())
        q, r, s = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
        return pa.Table.from_arrays([right.column("query_id").take(pa.array(q)), left.column(key).take(pa.array(r)), pa.array(s, pa.float64())], ["query_id", key, "score"])

    sides = [df.groupBy(*by, "dim") for df in (rows, asked)]
    return sides[0].cogroup(sides[1]).applyInArrow(best, f"query_id {kinds[0]}, `{key}` {kinds[1]}, score double")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def bm25_scores(docs: DataFrame, asked: DataFrame, by: list[str], key: str, columns: list[str]) -> DataFrame:
    """``by, key, score``: BM25 of every document that holds a term of ``asked`` (``by, term``),
    summed over the text columns, each with its own lengths and frequencies.

    A first pass counts: a text's distinct words and one empty word, which carries its length, give
    document frequencies, counts of texts and mean lengths.  Then texts move once, dealt by key: words
    are counted and scores summed where a document lies, so no pair of a query and a document is
    shuffled before its part's best are known.
    """

    def words(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(i).alias("column"), _words(F.col(c)).alias("words")) for i, c in enumerate(columns)])).alias("x")).select(key, "x.*")

    empty = F.array(F.lit(""))
    wanted = small(asked.select("term").union(asked.sparkSession.createDataFrame([("",)], "term string")).distinct(), 64)
    once = words(docs).select("column", F.size("words").alias("length"), F.explode(F.concat(F.array_distinct("words"), empty)).alias("term"))
    counts = stored(once.join(wanted, "term").groupBy("term", "column").agg(F.count("*").alias("df"), F.avg("length").alias("mean")), "counts")
    stats = counts.where("term = ''").select("column", F.col("df").alias("n"), "mean")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = stored(asked.join(counts.drop("mean"), "term").join(F.broadcast(stats), "column").select(*by, "term", "column", idf.alias("idf"), "mean"), "weights")
    placed = words(dealt(docs.select(key, *columns), parts(docs, DOCS), key))
    rows = placed.select(key, "column", F.size("words").alias("length"), F.explode("words").alias("term"))
    tf = rows.join(wanted.where("term <> ''"), "term").groupBy(key, "column", "length", "term").agg(F.count("*").alias("tf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return tf.join(small(weights, 128), ["term", "column"]).select(*by, key, weight.alias("w")).groupBy(*by, key).agg(F.sum("w").alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of every query (``query_id``, ``query``) by BM25."""
    asked = queries.select("query_id", F.explode(F.array_distinct(_words(F.col("query")))).alias("term"))
    return top(bm25_scores(docs, asked, ["query_id"], key, [text]), k, F.desc(F.round("score", 9)), F.col(key))


def lexical(docs: DataFrame, variations: DataFrame, k: int = 10, key: str = "id", columns: list[str] = ("text", "path")) -> DataFrame:
    """The ``k`` best documents of every query over its variations (``query_id, variation,
    query, weight``): each takes its own ``k // n + 1`` best by BM25 over all columns, and a
    document keeps its best weighted score."""
    asked = variations.select("query_id", "variation", F.explode(F.array_distinct(_words(F.col("query")))).alias("term"))
    scored = bm25_scores(docs, asked, ["query_id", "variation"], key, list(columns))
    share = variations.select("query_id", "variation", "weight", (F.floor(F.lit(k) / F.count("*").over(Window.partitionBy("query_id"))) + 1).alias("__most"))
    nth = F.row_number().over(Window.partitionBy("query_id", "variation").orderBy(F.desc(F.round("score", 9)), key))
    # No share is above k + 1: so bounded, only each part's best are shuffled.
    first = scored.withColumn("__nth", nth).where(F.col("__nth") <= k + 1).join(share, ["query_id", "variation"]).where(F.col("__nth") <= F.col("__most"))
    return top(best_of(first, key), k, F.desc(F.round("score", 9)), F.col(key))


def fused(semantic: DataFrame, lexical: DataFrame, key: str, semantic_weight: float = 0.7, lexical_weight: float = 0.3) -> DataFrame:
    """Both result lists joined by query and key: weighted sums of scores scaled to 0..1 per
    query.  Weights that do not add up to 1 are normalised."""
    total = semantic_weight + lexical_weight

    def scaled(df: DataFrame, name: str) -> DataFrame:
        return df.select("query_id", key, scores.min_max(F.col("score"), "query_id").alias(name))

    both = scaled(semantic, "s").join(scaled(lexical, "l"), ["query_id", key], "full_outer")
    s, lex = F.coalesce("s", F.lit(0.0)), F.coalesce("l", F.lit(0.0))
    source = F.when(F.col("s").isNull(), "lexical").when(F.col("l").isNull(), "semantic").otherwise("hybrid")
    return both.select("query_id", key, (s * semantic_weight / total + lex * lexical_weight / total).alias("score"), source.alias("source"))


def best_of(variations: DataFrame, key: str) -> DataFrame:
    """One row for each query and key with the best score over the query's variations
    (``weight`` scales a variation's score)."""
    return variations.groupBy("query_id", key).agg(F.max(F.col("score") * F.col("weight")).alias("score"))


def boosted(rows: DataFrame, modified: DataFrame, on: str, factor: float = 1.2) -> DataFrame:
    """Scores of rows whose ``on`` is in ``modified`` times the factor."""
    flag = small(modified.select(F.col(on).alias("__on")).distinct(), 64).withColumn("__hit", F.lit(True))
    return rows.join(flag, F.col(on) == F.col("__on"), "left").withColumn("score", F.when(F.col("__hit"), F.col("score") * factor).otherwise(F.col("score"))).drop("__on", "__hit")


def diverse(rows: DataFrame, file: str, key: str, cap: int = 3) -> DataFrame:
    """Ranks in which each query's first ``cap`` rows of a file keep their order and all
    further ones follow at the end."""
    by_score = [F.desc("score"), F.col(key)]
    nth = F.row_number().over(Window.partitionBy("query_id", file).orderBy(*by_score))
    late = rows.withColumn("late", nth > cap)
    return late.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("late", *by_score)))


def two_stage(corpus: DataFrame, queries: DataFrame, second: Column, k: int = 10, key: str = "id", vector: str = "embedding") -> DataFrame:
    """``3 k`` nearest by cosine, then the ``k`` best of these by ``second``, an expression
    over ``score`` and the corpus columns."""
    first = nearest(corpus, queries, 3 * k, -1.0, key, vector, metric="cosine").drop("rank")
    again = first.join(corpus.drop(vector), key).withColumn("score", second)
    return top(again, k, F.desc(F.round("score", 9)), F.col(key))


def graph_expanded(corpus: DataFrame, queries: DataFrame, edges: DataFrame, k: int = 10, key: str = "id", path: str = "path", vector: str = "embedding", depth: int = 2, least: float = 0.3, per_file: int = 100) -> DataFrame:
    """The ``k`` nearest of each query among its seeds (``k // 3``, five at most) and the chunks of
    files that the graph relates to theirs, so many a file."""
    from .graph import related

    first = stored(nearest(corpus, queries, min(5, max(1, k // 3)), -1.0, key, vector, metric="cosine").drop("rank").join(corpus.select(key, path), key), "seeds")
    near = related(edges, first.select(F.col(path).alias("seed")).distinct(), depth, least).select("seed", F.col("node").alias("__file"))
    nth = F.row_number().over(Window.partitionBy(path).orderBy(key))
    held = corpus.select(key, path, vector).withColumn("__nth", nth).where(F.col("__nth") <= per_file)
    files = corpus.select(F.col(path).alias("__file")).distinct()
    wanted = first.join(near.join(files, "__file"), F.col(path) == F.col("seed")).select("query_id", F.col("__file").alias(path)).distinct()
    # A file's chunks are few, its queries may be many: these are dealt to blocks.
    blocks = max(1, -(-queries.count() // PART))
    asked = wanted.join(_units(queries, "query_id", "query_vector"), "query_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    chunks = _units(held, key, vector, path).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    more = _multiplied(chunks, asked, [path, "block"], key, k)
    scored = first.select("query_id", key, "score").unionByName(more).groupBy("query_id", key).agg(F.max("score").alias("score"))
    return top(scored, k, F.desc(F.round("score", 9)), F.col(key))
