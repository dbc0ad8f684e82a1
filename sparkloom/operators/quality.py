"""Search quality, latencies, rates, and the events they are counted from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def mrr(clicks: DataFrame) -> DataFrame:
    """One row: mean over queries of 1 / the best clicked ``position``."""
    return clicks.groupBy("query_id").agg(F.min("position").alias("p")).agg(F.avg(F.try_divide(F.lit(1.0), F.col("p"))).alias("mrr"), F.count("*").alias("queries"))


def at_k(judged: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: mean precision and recall at each ``k``.

    ``judged`` has ``query_id, rank, relevant``.  A query without results is left out of
    precision, one without relevant results of recall.
    """
    r = F.col("relevant").cast("double")
    per = judged.groupBy("query_id").agg(F.sum(r).alias("all"), *[x for k in ks for x in (F.avg(F.when(F.col("rank") <= k, r)).alias(f"p{k}"), F.sum(F.when(F.col("rank") <= k, r)).alias(f"h{k}"))])
    recall = [F.avg(F.when(F.col("all") > 0, F.col(f"h{k}") / F.col("all"))).alias(f"recall_at_{k}") for k in ks]
    return per.agg(*[F.avg(f"p{k}").alias(f"precision_at_{k}") for k in ks], *recall)


def order_statistic(rows: DataFrame, by: str, value: str, positions: dict[str, Column], parts: int = 64) -> DataFrame:
    """Values at given zero-based places of each group's sorted values (nulls left out); a place
    is an expression over ``n``.

    Equal values are counted first.  Approximate quantiles cut each group into ranges, whose
    counts come before the exact ranks within, so a group is never sorted in one task.
    """
    rows = rows.where(F.col(value).isNotNull())
    cuts = rows.groupBy(by).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("__cuts"), F.count("*").alias("n"))
    counted = rows.groupBy(by, value).agg(F.count("*").alias("__c")).join(cuts, by)
    dealt = counted.select(by, value, "__c", "n", F.size(F.filter("__cuts", lambda x: x < F.col(value))).alias("__part"))
    before = F.sum("__c").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy(by, "__part").agg(F.sum("__c").alias("__c")).select(by, "__part", F.coalesce(before, F.lit(0)).alias("__off"))
    upto = F.sum("__c").over(Window.partitionBy(by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.withColumn("__upto", upto).join(offsets, [by, "__part"]).withColumn("__end", F.col("__off") + F.col("__upto"))

    def at(p: Column) -> Column:
        p = F.least(p, F.col("n") - 1).cast("long")
        return F.max(F.when((F.col("__end") - F.col("__c") <= p) & (p < F.col("__end")), F.col(value)))

    return ranked.groupBy(by).agg(*[at(p).alias(name) for name, p in positions.items()])


def latency(rows: DataFrame, by: str, value: str, limit_ms: float = 5000.0) -> DataFrame:
    """Counts and percentiles of each operation: the median is the n/2-th value, p95 the
    ceil(0.95 n)-th (or with ``_floor`` the int(0.95 n)-th from 0), p99 from 0 too."""
    n = F.col("n")
    places = {"p50": F.floor(n / 2), "p95": F.greatest(F.lit(0), F.ceil(0.95 * n - 1)), "p95_floor": F.floor(0.95 * n), "p99": F.floor(0.99 * n)}
    stats = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = stats.join(order_statistic(rows, by, value, places), by)
    return out.withColumn("meets_sla", F.col("p95") < limit_ms)


def last_k(rows: DataFrame, by: str, order: list[str], k: int = 1000) -> DataFrame:
    """The latest ``k`` rows of each group (a sliding counter)."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__nth", nth).where(F.col("__nth") <= k).drop("__nth")


def rate(hit: Column) -> Column:
    """Share of true values, 0 where there are none."""
    return F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))


def rates(rows: DataFrame, by: str, hit: Column, error: Column, least_hits: float = 0.5, most_errors: float = 0.05) -> DataFrame:
    """Hit and error rate of each group and whether both are healthy."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"), rate(hit).alias("hit_rate"), rate(error).alias("error_rate"))
    return out.withColumn("healthy", (F.col("hit_rate") >= least_hits) & (F.col("error_rate") <= most_errors))


def impact(rows: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """How much a filter or re-ranking changes: reduction, mean and largest change."""
    delta = F.abs(F.col(after) - F.col(before))
    reduced = F.when(F.sum(before) > 0, 1 - F.sum(after) / F.sum(before)).otherwise(0.0)
    return rows.groupBy(by).agg(reduced.alias("reduction"), F.avg(delta).alias("avg_delta"), F.max(delta).alias("max_delta"))


def counters(events: DataFrame, name: str, value: str, ts: str) -> DataFrame:
    """Counter (sum) and gauge (latest) of each metric."""
    return events.groupBy(name).agg(F.sum(value).alias("total"), F.max_by(value, ts).alias("latest"))
