"""Event queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import events as E
from ..session import scratch
from ..streaming import bus
from .tables import load


def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.replay(load(spark, sf_dir, "events"), "ts", "event_type", "2024-01-05 00:00:00", "2024-01-10 12:00:00", ["click", "error"])
    return rows.select("event_id", "event_type", "user_id")


def cooldown_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return E.cooldown(e, ["user_id", "event_type"], "at", "event_id", 86400.0).select("event_id", "user_id", "event_type")


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "added").otherwise("modified")
    feed = e.select("user_id", action.alias("action"), F.col("event_id").alias("seq"))
    state = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("indexed").alias("action"), F.lit(-1).cast("long").alias("seq"))
    return E.apply_feed(state, feed, "user_id", "action", "seq")


def invalidation_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("files"))
    rows = E.invalidations(li, ["index", "search", "conversation"], 10)
    return rows.groupBy("service").agg(F.count("*").alias("messages"), F.count_distinct("file").alias("files"))


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in E.STATES])
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("state"))
    rows = E.transitions(e, "user_id", "event_id", "state")
    return rows.groupBy("before", "state", "allowed").agg(F.count("*").alias("n"))


def state_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in E.STATES])
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("state"))
    rows = E.state_times(e, "user_id", "event_id", "state", "at", 600.0)
    return rows.groupBy("state").agg(F.sum("spent").alias("spent"), F.round(F.max("allowed"), 6).alias("allowed"), F.count_if("over").alias("over"))


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 100 + 1).alias("current"), F.lit(100).cast("long").alias("total"))


def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.progress(_progress(spark, sf_dir), "user_id", "current", "total", "at")
    return rows.select("user_id", "current", "total", F.round("percent", 6).alias("percent"), F.round("per_second", 9).alias("per_second"), "done")


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a stream that runs until it has read all files."""
    schema = load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = stream.select(F.col("user_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 100 + 1).alias("current"), F.lit(100).cast("long").alias("total"))
    name = f"progress_{uuid.uuid4().hex}"
    query = bus.progress(rows, "user_id", "at", "current", "total").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select("user_id", "current", "total", F.round("percent", 6).alias("percent"))


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


_FEED = "CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'added' ELSE 'modified' END"
_STATES = "['" + "', '".join(E.STATES) + "']"
_ALLOWED = " OR ".join(f"(before = '{a}' AND state = '{b}')" for a, bs in E.STATES.items() for b in bs)
SQL = {
    "event_replay": "SELECT event_id, event_type, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10 12:00:00' AND event_type IN ('click', 'error')",
    "cooldown_dedup": """
      WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
      r AS (SELECT *, sec AS last, true AS ok FROM e WHERE k = 1
        UNION ALL SELECT e.*, CASE WHEN e.sec - r.last >= 86400 THEN e.sec ELSE r.last END, e.sec - r.last >= 86400 FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.k = r.k + 1)
      SELECT event_id, user_id, event_type FROM r WHERE ok""",
    "change_feed": f"""
      WITH l AS (SELECT user_id, arg_max({_FEED}, event_id) AS action, max(event_id) AS seq FROM events GROUP BY user_id)
      SELECT * FROM l WHERE action <> 'deleted' UNION ALL SELECT c_custkey, 'indexed', -1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
    "invalidation_fanout": """
      WITH f AS (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS file FROM lineitem), k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY file) <= 10)
      SELECT unnest(['index', 'search', 'conversation']) AS service, count(*) AS messages, count(DISTINCT file) AS files FROM k""",
    "state_changes": f"""
      WITH s AS (SELECT user_id, event_id, {_STATES}[event_id % 6 + 1] AS state FROM events), b AS (SELECT state, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
      SELECT before, state, before IS NULL OR coalesce({_ALLOWED}, false) AS allowed, count(*) AS n FROM b GROUP BY ALL""",
    "state_times": f"""
      WITH s AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t, {_STATES}[event_id % 6 + 1] AS state FROM events), d AS (SELECT state, lead(t) OVER (PARTITION BY user_id ORDER BY event_id) - t AS spent FROM s),
      a AS (SELECT *, CASE state WHEN 'DREAMING' THEN 0.3 WHEN 'REM' THEN 0.4 WHEN 'MONITORING' THEN NULL ELSE 0.1 END * 36000 AS allowed FROM d)
      SELECT state, sum(spent)::BIGINT AS spent, round(max(allowed)::DOUBLE, 6) AS allowed, count(*) FILTER (spent > allowed) AS over FROM a GROUP BY state""",
    "task_progress": """
      WITH p AS (SELECT user_id, floor(epoch(ts))::BIGINT AS sec, event_id % 100 + 1 AS current FROM events), m AS (SELECT user_id, max({'a': sec, 'c': current}) AS x, min(sec) AS t0 FROM p GROUP BY user_id)
      SELECT user_id, x.c AS current, 100 AS total, round(x.c * 1.0, 6)::DOUBLE AS percent, round(CASE WHEN x.a > t0 THEN x.c / (x.a - t0) ELSE 0 END, 9) AS per_second, x.c >= 100 AS done FROM m""",
    "stream_progress": """
      WITH m AS (SELECT user_id, max({'a': ts, 'c': event_id % 100 + 1}) AS x FROM events GROUP BY user_id) SELECT user_id, x.c AS current, 100 AS total, round(x.c * 1.0, 6)::DOUBLE AS percent FROM m""",
    "windowed_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (event_replay, cooldown_dedup, change_feed, invalidation_fanout, state_changes, state_times, task_progress, stream_progress, windowed_events)}
