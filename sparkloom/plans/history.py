"""History queries: orders are commits, their lines the files they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import history, quality
from ..session import dealt, parts
from .tables import load

AS_OF = "2000-06-01 00:00:00"


def _message():
    p = F.col("o_orderpriority")
    return (
        F.when(p == "1-URGENT", "fix: Merge conflict in part").when(p == "2-HIGH", "feat(part): more").when(p == "3-MEDIUM", "refactor part")
        .when(p == "4-NOT SPECIFIED", "docs: words").otherwise("Update part")
    )


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes, dealt by path in proportion to the lines: a file's rows are grouped where they lie."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    n = parts(li)
    both = dealt(li, n, "l_orderkey").join(dealt(o, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = both.select(
        F.col("l_partkey").alias("path"), F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), _message().alias("message"),
        F.col("l_quantity").alias("insertions"), F.floor(F.col("l_discount") * 100).alias("deletions"),
    )
    return dealt(rows, n, "path")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 17 == 0, 0).otherwise(F.col("p_size") * 20).alias("lines"))


def _day(c: str):
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd").alias(c)


def file_commit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.commit_stats(_changes(spark, sf_dir), AS_OF)
    return rows.select("path", "total", "last_30", "weekly", "created_by", "last_author", _day("created_at"), _day("changed_at"), "pattern")


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _changes(spark, sf_dir).withColumn("author", F.col("author") % 10)
    rows = history.contributors(c, "path", "author", "ts")
    return rows.select("path", "author", "lines", "share", _day("first"), _day("last"))


def volatility_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.volatility(_changes(spark, sf_dir), _sizes(spark, sf_dir), AS_OF)
    return rows.select("path", "conflicts", F.round("volatility", 6).alias("volatility"), F.round("stability", 6).alias("stability"))


def directory_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.moves(load(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


def commit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"), _message().alias("message"))
    return history.type_histogram(c, "o_custkey")


def last_refactor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"), _message().alias("message"))
    return history.last_refactor(c, "o_custkey").select("o_custkey", _day("refactored_at"))


def conflict_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = load(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("path"))
    return history.conflict_risk(_changes(spark, sf_dir), staged)


def changes_by_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.by_others(_changes(spark, sf_dir), [1, 2, 3], AS_OF, 240).select("sha", "author", _day("ts"), "files")


def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent_files(_changes(spark, sf_dir), AS_OF, 30, 25).select("path", _day("changed_at"))


def activity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.activity_score(_changes(spark, sf_dir), AS_OF).select("path", "commits", F.round("activity", 6).alias("activity"))


def fatigue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir)
    files = history.volatility(changes, _sizes(spark, sf_dir), AS_OF)
    rows = history.fatigue(files, changes, "2000-05-20 00:00:00", AS_OF, ["1", "7", "12", "40"], 2)
    return rows.select(*[F.round(c, 6).alias(c) for c in ("time", "instability", "activity", "volatility", "architecture", "fatigue")], "level")


def fatigue_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.fatigue_history(spark, 14, 6.0, 4)
    return rows.select("days_ago", F.round("fatigue", 6).alias("fatigue"))


def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.metrics(_changes(spark, sf_dir), _sizes(spark, sf_dir), AS_OF)
    return rows.select("path", "lines", F.round("stability", 6).alias("stability"), "total", "last_30", "pattern")


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 20 + 1).alias("position"))
    return quality.mrr(e).select(F.round("mrr", 6).alias("mrr"), "queries")


def precision_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    from ..operators.search import top

    rows = d.join(lab, "doc_id").select(F.col("source").alias("query_id"), "doc_id", "n_chars", (F.col("quality") == 1).alias("relevant"))
    rows = top(rows, 1 << 30, F.desc("n_chars"), F.col("doc_id"))
    out = quality.at_k(rows)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = quality.last_k(load(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 1000)
    rows = quality.latency(e, "event_type", "value", 80.0)
    return rows.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("avg", "min", "max", "p50", "p95", "p95_floor", "p99")], "meets_sla")


def cache_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    rows = quality.rates(e, "user_id", F.col("event_type").isin("view", "click"), F.col("event_type") == "error", 0.3, 0.2)
    return rows.select("user_id", "n", F.round("hit_rate", 6).alias("hit_rate"), F.round("error_rate", 6).alias("error_rate"), "healthy")


def rerank_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").withColumn("after", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    rows = quality.impact(li, "l_returnflag", "l_extendedprice", "after")
    return rows.select("l_returnflag", F.round("reduction", 6).alias("reduction"), F.round("avg_delta", 4).alias("avg_delta"), F.round("max_delta", 4).alias("max_delta"))


def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.counters(load(spark, sf_dir, "events"), "event_type", "value", "event_id")
    return rows.select("event_type", F.round("total", 4).alias("total"), F.round("latest", 6).alias("latest"))


_M = """CASE o_orderpriority WHEN '1-URGENT' THEN 'fix: Merge conflict in part' WHEN '2-HIGH' THEN 'feat(part): more' WHEN '3-MEDIUM' THEN 'refactor part' WHEN '4-NOT SPECIFIED' THEN 'docs: words' ELSE 'Update part' END"""
_C = f"""c AS (SELECT l_partkey AS path, o_orderkey AS sha, o_custkey AS author, o_orderdate AS ts, {_M} AS message, l_quantity AS insertions, floor(l_discount * 100) AS deletions,
  floor(epoch(TIMESTAMP '2000-06-01' - o_orderdate) / 86400) AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  z AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_size * 20 END AS lines FROM part),
  v0 AS (SELECT z.path, lines, coalesce(conflicts, 0) AS conflicts, CASE WHEN changed IS NULL THEN 0.1 WHEN lines = 0 THEN 1.0 ELSE least(1.0, changed / lines) END AS volatility
         FROM z LEFT JOIN (SELECT path, sum(insertions + deletions) FILTER (age BETWEEN 0 AND 30) AS changed, count(DISTINCT sha) FILTER (lower(message) LIKE '%merge conflict%') AS conflicts FROM c GROUP BY path) USING (path)),
  v AS (SELECT *, greatest(0.0, least(1.0, 1 - least(0.6, 0.1 * conflicts) - 0.4 * volatility)) AS stability FROM v0),
  u AS (SELECT path, sha, min(ts) AS ts, min(age) AS age, min(author) AS author FROM c GROUP BY ALL),
  st AS (SELECT path, count(*) AS total, least(50, count(*) FILTER (age BETWEEN 0 AND 30)) AS last_30, round(count(*) FILTER (age BETWEEN 0 AND 365) / 52, 2) AS weekly,
         arg_min(author, {{'t': ts, 's': sha}}) AS created_by, arg_max(author, {{'t': ts, 's': sha}}) AS last_author, strftime(min(ts), '%Y-%m-%d') AS created_at, strftime(max(ts), '%Y-%m-%d') AS changed_at FROM u GROUP BY path),
  s2 AS (SELECT *, CASE WHEN last_30 = 0 THEN 'inactive' WHEN last_30 > 2 * (total * 0.1) THEN 'burst' WHEN weekly >= 1 THEN 'steady' ELSE 'sporadic' END AS pattern FROM st)"""
SQL = {
    "file_commit_stats": f"WITH {_C} SELECT * FROM s2",
    "contributors": f"""WITH {_C}, n AS (SELECT path, author % 10 AS author, count(*) AS lines, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last FROM c GROUP BY 1, 2)
      SELECT path, author, lines, round(lines * 100 / sum(lines) OVER (PARTITION BY path), 1) AS share, first, last FROM n""",
    "volatility_stability": f"WITH {_C} SELECT path, conflicts, round(volatility, 6) AS volatility, round(stability, 6) AS stability FROM v",
    "directory_moves": "WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, count_if(b <> event_type)::BIGINT AS moves FROM l GROUP BY user_id",
    "commit_types": f"""WITH r AS (SELECT o_custkey, {_M} AS message, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
      t AS (SELECT o_custkey, regexp_extract(lower(message), '^(feat|fix|docs|style|refactor|test|chore)[:( ]', 1) AS t FROM r WHERE k <= 100)
      SELECT o_custkey, CASE WHEN t = '' THEN 'other' ELSE t END AS type, count(*) AS n FROM t GROUP BY 1, 2""",
    "last_refactor": f"""WITH r AS (SELECT o_custkey, o_orderdate, {_M} AS message, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
      SELECT o_custkey, strftime(max(o_orderdate) FILTER (message LIKE '%refactor%'), '%Y-%m-%d') AS refactored_at FROM r WHERE k <= 50 GROUP BY o_custkey""",
    "conflict_risk": f"""WITH {_C}, r AS (SELECT path, author, row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha DESC) AS k FROM (SELECT path, sha, max(ts) AS ts, max(author) AS author FROM c GROUP BY ALL)),
      n AS (SELECT path, count(DISTINCT author) AS authors FROM r WHERE k <= 3 GROUP BY path),
      s AS (SELECT path, authors, (CASE WHEN authors >= 2 THEN least(10, 5 + 2 * authors) ELSE 0 END + CASE WHEN p_size > 45 THEN 5 ELSE 0 END)::BIGINT AS severity FROM n JOIN part ON p_partkey = path)
      SELECT *, CASE WHEN severity >= 10 THEN 'coordinate' WHEN severity >= 5 THEN 'review' ELSE 'none' END AS advice FROM s""",
    "changes_by_others": f"""WITH {_C} SELECT sha, author, strftime(max(ts), '%Y-%m-%d') AS ts, string_agg(DISTINCT path::VARCHAR, ',' ORDER BY path::VARCHAR) AS files FROM c
      WHERE ts > TIMESTAMP '2000-06-01' - INTERVAL 240 HOUR AND ts <= TIMESTAMP '2000-06-01' AND author NOT IN (1, 2, 3) GROUP BY sha, author""",
    "recent_files": f"WITH {_C} SELECT path, strftime(max(ts), '%Y-%m-%d') AS changed_at FROM c WHERE age BETWEEN 0 AND 30 GROUP BY path ORDER BY max(ts) DESC, path LIMIT 25",
    "activity_score": f"""WITH {_C}, n AS (SELECT path, min(age) AS age, count(DISTINCT sha) AS commits, sum(insertions + deletions) AS lines FROM c GROUP BY path),
      a AS (SELECT path, commits, 0.4 * greatest(0, least(1, 1 - age / 30)) + 0.3 * least(1, commits / 10) + 0.2 * least(1, lines / 500) AS a FROM n)
      SELECT path, commits, round(a, 6) AS activity FROM a ORDER BY round(a, 9) DESC, path LIMIT 50""",
    "fatigue_score": f"""WITH {_C}, w AS (SELECT avg(1 - stability) AS instability, avg(volatility) AS volatility FROM v WHERE path IN (SELECT path FROM c WHERE age BETWEEN 0 AND 7)),
      m AS (SELECT * FROM c WHERE age BETWEEN 0 AND 30), f AS (SELECT count(*) AS files, count(*) FILTER (k > 10) AS busy FROM (SELECT path, count(DISTINCT sha) AS k FROM m GROUP BY path)),
      t AS (SELECT count(DISTINCT sha) AS commits, count(DISTINCT path) FILTER (path IN (1, 7, 12, 40)) AS man FROM m),
      p AS (SELECT least(1.0, 12 / 30) AS time, coalesce(instability, 0) AS instability, 0.3 * least(1.0, files / 100) + 0.4 * least(1.0, commits / 200) + 0.3 * least(1.0, busy / 10) AS activity,
            coalesce(volatility, 0) AS volatility, 0.7 * least(1.0, man / 3) + 0.3 * 0.4 AS architecture FROM w, f, t),
      s AS (SELECT *, least(10.0, time + 3 * instability + 3 * activity + 2 * volatility + architecture) AS fatigue FROM p)
      SELECT round(time, 6) AS time, round(instability, 6) AS instability, round(activity, 6) AS activity, round(volatility, 6) AS volatility, round(architecture, 6) AS architecture, round(fatigue, 6) AS fatigue,
             CASE WHEN fatigue > 9.5 THEN 'emergency' WHEN fatigue > 7.5 THEN 'high' WHEN fatigue > 5 THEN 'moderate' WHEN fatigue > 3 THEN 'low' ELSE 'rested' END AS level FROM s""",
    "fatigue_history": """SELECT d AS days_ago, round(CASE WHEN d <= 4 THEN greatest(0.0, 6.0 - 0.2 * d) ELSE least(10.0, greatest(0.0, (6.0 - 0.2 * 4) / 0.3 - 0.2 * (d - 4))) END::DOUBLE, 6) AS fatigue FROM range(15) t(d)""",
    "file_metrics": f"WITH {_C} SELECT path, lines, round(stability, 6) AS stability, total, last_30, pattern FROM v LEFT JOIN s2 USING (path)",
    "mrr": "WITH p AS (SELECT user_id, min(event_id % 20 + 1) AS p FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT round(avg(1 / p), 6) AS mrr, count(*) AS queries FROM p",
    "precision_recall_at_k": """
      WITH r AS (SELECT source, (quality = 1)::INT AS rel, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents JOIN labels USING (doc_id)),
      q AS (SELECT source, sum(rel) AS a, avg(rel) FILTER (k <= 1) AS p1, avg(rel) FILTER (k <= 5) AS p5, avg(rel) FILTER (k <= 10) AS p10, sum(rel) FILTER (k <= 1) AS h1, sum(rel) FILTER (k <= 5) AS h5, sum(rel) FILTER (k <= 10) AS h10 FROM r GROUP BY source)
      SELECT round(avg(p1), 6) AS precision_at_1, round(avg(p5), 6) AS precision_at_5, round(avg(p10), 6) AS precision_at_10,
             round(avg(h1 / a) FILTER (a > 0), 6) AS recall_at_1, round(avg(h5 / a) FILTER (a > 0), 6) AS recall_at_5, round(avg(h10 / a) FILTER (a > 0), 6) AS recall_at_10 FROM q""",
    "latency_stats": """
      WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
      s AS (SELECT event_type, count(*) AS n, avg(value) AS a, list_sort(list(value)) AS v FROM k WHERE k <= 1000 GROUP BY event_type)
      SELECT event_type, n, round(a, 6) AS avg, round(v[1], 6) AS min, round(v[n], 6) AS max, round(v[(n // 2) + 1], 6) AS p50, round(v[greatest(0, ceil(0.95 * n - 1))::BIGINT + 1], 6) AS p95,
             round(v[least(n - 1, floor(0.95 * n))::BIGINT + 1], 6) AS p95_floor, round(v[least(n - 1, floor(0.99 * n))::BIGINT + 1], 6) AS p99, v[greatest(0, ceil(0.95 * n - 1))::BIGINT + 1] < 80 AS meets_sla FROM s""",
    "cache_rates": """
      WITH r AS (SELECT user_id, count(*) AS n, avg((event_type IN ('view', 'click'))::INT) AS h, avg((event_type = 'error')::INT) AS e FROM events GROUP BY user_id)
      SELECT user_id, n, round(h, 6) AS hit_rate, round(e, 6) AS error_rate, h >= 0.3 AND e <= 0.2 AS healthy FROM r""",
    "rerank_impact": """
      SELECT l_returnflag, round(1 - sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) AS reduction,
             round(avg(abs(l_extendedprice * (1 - l_discount) - l_extendedprice)), 4) AS avg_delta, round(max(abs(l_extendedprice * (1 - l_discount) - l_extendedprice)), 4) AS max_delta FROM lineitem GROUP BY 1""",
    "metric_counters": "SELECT event_type, round(sum(value), 4) AS total, round(arg_max(value, event_id), 6) AS latest FROM events GROUP BY 1",
}
QUERIES = {
    f.__name__: f
    for f in (
        file_commit_stats, contributors, volatility_stability, directory_moves, commit_types, last_refactor, conflict_risk, changes_by_others, recent_files, activity_score,
        fatigue_score, fatigue_history, file_metrics, mrr, precision_recall_at_k, latency_stats, cache_rates, rerank_impact, metric_counters,
    )
}
