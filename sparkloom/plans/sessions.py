"""Conversation and task queries: customers are tasks, orders their sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import sessions
from .tables import load


def _day(c: str):
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd").alias(c)


def _tables(spark: SparkSession, sf_dir: str):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    tasks = c.select(F.col("c_custkey").alias("task_id"), "c_mktsegment")
    links = o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("session_id"))
    return tasks, links, o


def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, links, _ = _tables(spark, sf_dir)
    turns = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("ts"))
    return sessions.task_summary(tasks, links, turns).select("task_id", "c_mktsegment", "sessions", "messages", _day("last_activity"))


def task_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, links, o = _tables(spark, sf_dir)
    work = o.select(F.col("o_orderkey").alias("session_id"), F.floor("o_totalprice").alias("tokens"), F.col("o_orderdate").alias("ts"))
    made = o.where("o_orderpriority in ('1-URGENT', '2-HIGH')").select(F.col("o_custkey").alias("task_id"))
    return sessions.task_activity(tasks, links, work, made).select("task_id", "sessions", "tokens", "decisions", _day("first"), _day("last"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").where("o_orderdate >= '1998-01-01'").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"))
    li = load(spark, sf_dir, "lineitem").where("l_shipdate >= '1998-01-01'").select(F.col("l_shipdate").alias("ts"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"))
    return sessions.timeline({"session": o, "decision": li}, 100).select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts"), "id", "kind")


def conversation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.activity_counts(load(spark, sf_dir, "events"), "ts", "2024-01-20 12:00:00")


def rolling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return sessions.rolling_summary(c, "conv_id", "turn", F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, 30)), T.crude_estimate(F.col("text")))


def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_messages(load(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


def session_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("session_id"))
    rows = sessions.related_sessions(sessions.chain(o, "o_custkey", "session_id"))
    return rows.select("from_session", "session_id", "o_custkey")


def session_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains through stored lists: each order lists the one before it of its customer, every third
    also the one before that; first orders of every other customer list the last one, in a circle,
    or themselves, or one that is not there."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.array_compact(F.array(F.when(F.col("o_orderkey") % 3 == 0, F.lag("o_orderkey", 2).over(w)), F.lag("o_orderkey").over(w)))
    other = F.when(F.col("o_custkey") % 4 == 0, F.max("o_orderkey").over(whole)).when(F.col("o_custkey") % 4 == 2, F.col("o_orderkey")).when(F.col("o_custkey") % 4 == 1, -F.col("o_orderkey"))
    rows = o.select(F.col("o_orderkey").alias("session_id"), F.when(F.size(before) > 0, before).otherwise(F.array_compact(F.array(other))).alias("related"))
    found = sessions.linked_chain(rows)
    return found.select("session_id", F.size("chain").alias("n"), F.array_join("chain", ",").alias("chain"))


def insight_dedup_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    severity = F.element_at(F.array(*[F.lit(x) for x in ("LOW", "CRITICAL", "MEDIUM", "HIGH", "NOTE")]), (F.col("user_id") % 5 + 1).cast("int"))
    rows = e.select("event_id", "event_type", severity.alias("severity"), F.floor(F.col("value") / 10).alias("bucket"))
    rows = sessions.deduplicated(rows, ["event_type", "severity", "bucket"], "event_id")
    top = sessions.top_findings(rows, "event_type", "severity", "event_id", 5)
    return top.select("event_type", "event_id", "severity", "bucket", "copies", "rank", sessions.confidence(F.col("severity")).alias("confidence"))


def insight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    old = sessions.older_than(e, "ts", "2024-01-31 00:00:00", 15)
    return e.groupBy("event_type").agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))


_CONV = "text"
SQL = {
    "task_summary": """
      WITH t AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS m, max(l_shipdate) AS ts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
      SELECT c_custkey AS task_id, c_mktsegment, count(o_orderkey) AS sessions, coalesce(sum(m), 0)::BIGINT AS messages, strftime(max(ts), '%Y-%m-%d') AS last_activity
      FROM customer LEFT JOIN t ON o_custkey = c_custkey GROUP BY ALL""",
    "task_activity": """
      SELECT c_custkey AS task_id, count(o_orderkey) AS sessions, coalesce(sum(floor(o_totalprice)), 0)::BIGINT AS tokens, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS decisions,
             strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "timeline": """
      WITH u AS (SELECT o_orderdate AS ts, o_orderkey::VARCHAR AS id, 'session' AS kind FROM orders WHERE o_orderdate >= '1998-01-01'
        UNION ALL SELECT l_shipdate, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'decision' FROM lineitem WHERE l_shipdate >= '1998-01-01')
      SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, id, kind FROM u ORDER BY u.ts, kind, id LIMIT 100""",
    "conversation_stats": """
      SELECT count(*) AS total, count_if(ts::DATE = DATE '2024-01-20')::BIGINT AS today, count_if(ts::DATE <= DATE '2024-01-20' AND ts::DATE > DATE '2024-01-13')::BIGINT AS week FROM events""",
    "rolling_summary": """
      SELECT conv_id, turn, string_agg(role || ': ' || substr(text, 1, 30), ' | ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS summary,
             (sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS total_tokens FROM conversations""",
    "last_messages": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "session_chain": """
      WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
      SELECT a.o_orderkey AS from_session, b.o_orderkey AS session_id, a.o_custkey FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.k BETWEEN a.k - 5 AND a.k - 1""",
    "session_links": """
      WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_custkey % 4 AS m, lag(o_orderkey) OVER w AS one, lag(o_orderkey, 2) OVER w AS two, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
      r AS (SELECT id, CASE WHEN one IS NULL THEN list_filter([CASE m WHEN 0 THEN last WHEN 2 THEN id WHEN 1 THEN -id END], lambda x: x IS NOT NULL)
                       ELSE list_filter([CASE WHEN id % 3 = 0 THEN two END, one], lambda x: x IS NOT NULL) END AS list FROM o),
      way AS (SELECT id, list, list[-1] AS nxt, 1 AS hop FROM r
              UNION ALL SELECT way.id, list_concat(way.list, r.list), r.list[-1], hop + 1 FROM way JOIN r ON r.id = way.nxt WHERE hop < 12),
      longest AS (SELECT id, max_by(list, hop) AS list FROM way GROUP BY id),
      firsts AS (SELECT id, x, min(i) AS i FROM (SELECT id, unnest(list) AS x, generate_subscripts(list, 1) AS i FROM longest) WHERE x <> id GROUP BY ALL),
      five AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) <= 5)
      SELECT r.id AS session_id, count(x)::INT AS n, coalesce(string_agg(x::VARCHAR, ',' ORDER BY i), '') AS chain FROM r LEFT JOIN five ON r.id = five.id GROUP BY r.id""",
    "insight_dedup_rank": """
      WITH e AS (SELECT event_id, event_type, ['LOW', 'CRITICAL', 'MEDIUM', 'HIGH', 'NOTE'][user_id % 5 + 1] AS severity, floor(value / 10)::BIGINT AS bucket FROM events),
      d AS (SELECT event_type, severity, bucket, min(event_id) AS event_id, count(*) AS copies FROM e GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, event_id) AS rank FROM d)
      SELECT event_type, event_id, severity, bucket, copies, rank::INT AS rank, CASE severity WHEN 'CRITICAL' THEN 0.9 WHEN 'HIGH' THEN 0.9 WHEN 'MEDIUM' THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM r WHERE rank <= 5""",
    "insight_counts": """
      SELECT event_type, count_if(ts < TIMESTAMP '2024-01-16')::BIGINT AS deleted, count_if(ts >= TIMESTAMP '2024-01-16')::BIGINT AS kept FROM events GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (task_summary, task_activity, timeline, conversation_stats, rolling_summary, last_messages, session_chain, session_links, insight_dedup_rank, insight_counts)}
