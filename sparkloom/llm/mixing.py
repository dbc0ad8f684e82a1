"""Mixing sources to target weights by temperature.

A source's weight is its token share to a power, normalised.  The exponent is bisected
between 0 (equal weights) and 1 (shares as they are) until the weights' entropy reaches a
target, or until no source repeats more often than a limit allows.  The budget is the
smallest at which no document is left out, so every source is repeated between once and
limit times; the largest relative to its weight exactly once.

A source's repetitions are whole passes over it and one partial pass.  The partial pass
takes documents in a block permutation (blocks of about ``BLOCK`` documents in shuffled
order, shuffled documents within) until its share of the source's tokens is spent.  Sums
over blocks come first, so no source, however large, is ordered in one task.

Only built-in functions are used.  Defined results: null text counts as empty; a document
has one token more than words, so each has some.  A null source is a source of its own.
Equal shares are left as they are.  Repeated rows are separate documents; those with equal
id and source go together.  An empty table gives no rows.  ``mixed`` leaves out columns that
start with ``__mix``, as its own do; ``repeated`` keeps all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import fresh, read, stored

#: Documents in a block, on average.
BLOCK = 256
#: Hexadecimal digits that name a range of blocks: a source has at most 4,096 ranges.
RANGE = 3
#: Bisections of one pass over the sources (all their 2^n - 1 inner points at once), passes.
DEEP, PASSES = 4, 10


def tokens(text: Column) -> Column:
    """Words of the text, and one for its end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def exponent(sources: DataFrame, limit: float | None = None, entropy: float | None = None) -> float:
    """Largest exponent in [0, 1] whose weights meet the target, from ``share`` of each source.

    ``limit``: most repetitions of a source against the least repeated one.  ``entropy``:
    at least so many nats.  Only sums over the sources reach the driver.
    """
    if (limit is None) == (entropy is None):
        raise ValueError("give either a repetition limit or an entropy")
    low, high = 0.0, 1.0
    for step in range(PASSES):
        n = 2**DEEP
        points = [low + (high - low) * i / n for i in range(n + 1)]
        if step == 0 or entropy is not None:
            p = F.col("share")
            sums = sources.agg(
                F.max("share").alias("hi"), F.min("share").alias("lo"),
                *[x for i, t in enumerate(points) for x in (F.sum(F.pow(p, F.lit(t))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(t)) * F.log(p)).alias(f"s{i}"))],
            ).first()
        if sums["hi"] is None:
            return 1.0

        def met(i: int) -> bool:
            if limit is not None:
                return (1 - points[i]) * math.log(sums["hi"] / sums["lo"]) <= math.log(limit)
            z, s = sums[f"z{i}"], sums[f"s{i}"]
            return math.log(z) - points[i] * s / z >= entropy

        if limit is not None:  # a smaller exponent repeats rare sources more
            if met(0):
                return 0.0 if step == 0 else points[0]
            i = next(i for i in range(1, n + 1) if met(i))
            low, high = points[i - 1], points[i]
        else:  # a smaller exponent has more entropy
            if met(n):
                return points[n]
            if not met(0):
                return points[0]
            i = max(i for i in range(n) if met(i))
            low, high = points[i], points[i + 1]
    return high if limit is not None else low


def _rank(*parts) -> Column:
    """Pseudo-random text that orders rows."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def mixed(docs: DataFrame, limit: float | None = 2.0, entropy: float | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` and, for each, ``__mix_tokens``, ``__mix_copies`` and its source's
    ``__mix_share`` and ``__mix_weight``."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("__mix")])
    docs = docs.withColumn("__mix_tokens", tokens(F.col(text)))
    docs = docs.withColumn("__mix_source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    found = stored(docs.groupBy("__mix_source").agg(F.sum("__mix_tokens").alias("total"), F.count("*").alias("docs")), "sources")
    total = found.agg(F.sum("total")).first()[0] or 1
    shares = found.withColumn("share", F.col("total") / F.lit(float(total)))
    t = exponent(shares, limit, entropy)
    raw = shares.withColumn("raw", F.pow("share", F.lit(t)))
    sums = raw.agg(F.sum("raw").alias("z"), F.min(F.col("raw") / F.col("share")).alias("least")).first()
    z, least = sums["z"] or 1.0, sums["least"] or 1.0
    rates = raw.select(
        F.col("__mix_source").alias("__mix_s"), F.col("total").alias("__mix_total"), F.col("share").alias("__mix_share"),
        (F.col("raw") / z).alias("__mix_weight"), F.round(F.col("raw") / F.col("share") / least, 9).alias("__mix_rate"),
        F.ceil(F.col("docs") / BLOCK).alias("__mix_blocks"),
    )
    rows = docs.join(rates, F.col("__mix_source") == F.col("__mix_s"))
    rows = rows.withColumn("__mix_block", F.conv(F.substring(_rank(F.col(doc_id), F.col("__mix_source")), 1, 8), 16, 10).cast("long") % F.col("__mix_blocks"))
    rows = rows.withColumn("__mix_whole", F.floor("__mix_rate"))

    # Blocks are ordered by their pseudo-random text: ranges of it first, then blocks within.
    sums = rows.groupBy("__mix_source", "__mix_block", "__mix_whole").agg(F.sum("__mix_tokens").alias("sum"))
    sums = stored(sums.withColumn("rank", _rank(F.col("__mix_source"), F.col("__mix_block"), F.col("__mix_whole"))).withColumn("range", F.substring("rank", 1, RANGE)), "blocks")
    earlier = F.sum("sum").over(Window.partitionBy("__mix_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = sums.groupBy("__mix_source", "range").agg(F.sum("sum").alias("sum")).select("__mix_source", "range", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    order = Window.partitionBy("__mix_source", "range").orderBy("rank", "__mix_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.withColumn("inside", F.coalesce(F.sum("sum").over(order), F.lit(0))).join(ranges, ["__mix_source", "range"])
    blocks = blocks.select(F.col("__mix_source").alias("bs"), F.col("__mix_block").alias("bb"), (F.col("earlier") + F.col("inside")).alias("__mix_before"))

    within = Window.partitionBy("__mix_source", "__mix_block").orderBy(_rank(F.col(doc_id), F.col("__mix_whole")), doc_id).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__mix_in", F.coalesce(F.sum("__mix_tokens").over(within), F.lit(0)))
    rows = rows.join(blocks, (F.col("__mix_source") == F.col("bs")) & (F.col("__mix_block") == F.col("bb"))).drop("bs", "bb")
    partial = (F.col("__mix_rate") - F.col("__mix_whole")) * F.col("__mix_total")
    takes = F.col("__mix_before") + F.col("__mix_in") + F.col("__mix_tokens") / 2 < partial
    rows = rows.withColumn("__mix_copies", F.col("__mix_whole") + takes.cast("long"))
    return rows.select(*docs.columns, "__mix_copies", "__mix_share", "__mix_weight").drop("__mix_source")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mixture has it."""
    names = docs.columns
    own = {c: fresh(names, f"__own{i}") for i, c in enumerate(names) if c.lower().startswith("__mix")}
    rows = mixed(docs.withColumnsRenamed(own), **options)
    rows = rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies"))))
    return rows.select(*[F.col(own.get(c, c)).alias(c) for c in names])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select(
        "doc_id", "source", F.col("__mix_tokens").alias("n_tokens"), F.col("__mix_copies").alias("copies"),
        F.round("__mix_share", 6).alias("share"), F.round("__mix_weight", 6).alias("weight"),
    )


#: The same in DuckDB; for a repetition limit the exponent has a closed form.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n_tokens
  FROM documents
), f AS (
  SELECT s, sum(n_tokens) AS total, count(*) AS docs, sum(n_tokens) / sum(sum(n_tokens)) OVER ()::DOUBLE AS share FROM d GROUP BY s
), e AS (
  SELECT CASE WHEN max(share) = min(share) THEN 0.0 ELSE greatest(0.0, 1 - ln(2.0) / ln(max(share) / min(share))) END AS t FROM f
), r AS (
  SELECT s, total, docs, share, pow(share, t) AS raw FROM f, e
), w AS (
  SELECT s, total, share, raw / sum(raw) OVER () AS weight,
         round(raw / share / min(raw / share) OVER (), 9) AS rate, ceil(docs / 256.0)::BIGINT AS blocks FROM r
), b AS (
  SELECT doc_id, source, d.s, n_tokens, total, share, weight, rate, floor(rate)::BIGINT AS whole,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || d.s), 1, 8))::BIGINT % blocks AS block
  FROM d JOIN w ON d.s = w.s
), k AS (
  SELECT s, block, coalesce(sum(sum(n_tokens)) OVER (PARTITION BY s ORDER BY md5(s || ':' || block::VARCHAR || ':' || whole::VARCHAR), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b GROUP BY s, block, whole
), i AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY s, block ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || whole::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS within FROM b
)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens,
       whole + (before + within + n_tokens / 2.0 < (rate - whole) * total)::BIGINT AS copies,
       round(share, 6) AS share, round(weight, 6) AS weight
FROM i JOIN k ON i.s = k.s AND i.block = k.block
"""
