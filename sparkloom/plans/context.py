"""Queries about prompts, insights and pluggable models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import context, history, insights, plugins
from . import history as H
from .tables import load, spread


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "simple").when(F.col("role") == "system", "generation").otherwise("normal")
    return c.select("conv_id", "turn", context.budget(32768, kind).alias("b")).select("conv_id", "turn", "b.*")


def budget_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("budget_id"), F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("priority"))
    return context.rebalanced(rows, 10000).select("budget_id", "category", F.col("tokens").cast("long").alias("tokens"))


def messages_that_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").withColumn("t", T.crude_estimate(F.col("text")))
    return context.fitting(c, "conv_id", "turn", "role", "t", 60)


def exchange_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.exchanges(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(load(spark, sf_dir, "part").select("p_partkey", "p_name"))
    query = F.concat(F.lit("show "), F.regexp_replace(F.initcap("p_name"), " ", ""), F.lit(" of "), F.regexp_replace("p_name", " ", "_"))
    return p.select("p_partkey", F.posexplode(context.expanded(query)).alias("place", "query"))


def cycle_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").withColumn("total", F.col("p_partkey") * 1499 % 200_000)
    size = F.element_at(F.array(*[F.lit(x) for x in ("8k", "32k", "128k")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select("p_partkey", context.cycle_budget(F.col("total"), F.col("p_size") % 3 + 1, size).alias("b")).select("p_partkey", "b.*")


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    lang = F.when(F.col("p_size") % 2 == 0, F.lower("p_brand"))
    return p.select("p_partkey", context.search_text(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")), F.col("p_brand"), lang, words, F.slice(words, 1, 1), F.array().cast("array<string>")).alias("text"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    kinds = F.array(*[F.lit(x) for x in ("Bug risk", "security hole", "Performance", "Architecture drift", "pattern", "note")])
    levels = F.array(*[F.lit(x) for x in ("CRITICAL", "high", "MEDIUM", "LOW")])
    return o.select(F.col("o_orderkey").alias("id"), F.element_at(kinds, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("type"), F.element_at(levels, (F.col("o_custkey") % 4 + 1).cast("int")).alias("severity"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("description"))


def finding_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(spark, sf_dir).select(insights.category(F.col("type")).alias("category"), insights.stored_kind(F.col("type")).alias("kind"), insights.impact(F.col("severity")).alias("impact"))
    return rows.groupBy("category", "kind", "impact").agg(F.count("*").alias("n"))


def finding_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.consolidated(_findings(spark, sf_dir)).select("id", "category", "severity")


def fatigue_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.explanation(H.fatigue_score(spark, sf_dir))
    level = F.col("fatigue")
    return rows.select("explanation", insights.recommendation(level).alias("recommendation"), F.round(insights.reduced(level), 6).alias("reduced"), F.round(insights.model_fatigue(level, level, level, level), 6).alias("model"))


def fatigue_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.metrics(H._changes(spark, sf_dir), H._sizes(spark, sf_dir), H.AS_OF)
    return insights.triggers(rows)


def analysis_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    level = (F.col("turn") * 1.3 + 5).cast("double")
    last = F.when(F.col("turn") % 3 == 0, None).otherwise(F.lit("2024-01-01 10:30:00"))
    gate = insights.suggests(level, F.concat(F.col("text"), F.when(F.col("conv_id") % 2 == 0, " fix").otherwise("")), last, F.col("conv_id") % 5 == 0, F.lit("2024-01-01 12:00:00"))
    return c.select("conv_id", "turn", gate.alias("suggest"))


def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plugins.encoded(load(spark, sf_dir, "documents"))
    return rows.select("key", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


def cross_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    rows = c.where("role = 'user'").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query")).join(c.where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), "text", F.col("turn").cast("double").alias("score")), "query_id")
    return plugins.rescored(rows, "query", "text").groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


_F = "f AS (SELECT o_orderkey AS id, ['Bug risk', 'security hole', 'Performance', 'Architecture drift', 'pattern', 'note'][o_orderkey % 6 + 1] AS type, ['CRITICAL', 'high', 'MEDIUM', 'LOW'][o_custkey % 4 + 1] AS severity FROM orders), g AS (SELECT *, ['bugs', 'security', 'performance', 'architecture', 'patterns', 'other'][id % 6 + 1] AS category FROM f)"
_CODE = " OR ".join(f"contains(m, '{w}')" for w in T.CODE_WORDS)
_INTENT = "CASE " + " ".join(f"""WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} THEN '{name}'""" for name, words in context.INTENTS) + " ELSE 'general' END"
_ENTITY = {k: f"list_sort(list_distinct(list_filter(regexp_extract_all(b, '{p}', 1), lambda x: x <> '')))" for k, p in context.SUMMARY_ENTITIES.items()}
SQL = {
    "query_expansion": """
      WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') AS s, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS c, string_split(p_name, ' ') AS w FROM part),
      v AS (SELECT *, lower(w[1]) || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || lower(x[2:])), '') AS camel FROM p)
      SELECT p_partkey, unnest([0, 1, 2, 3, 4]) AS place, unnest(['show ' || c || ' of ' || s, 'show ' || s || ' of ' || s, 'show ' || camel || ' of ' || s, 'show ' || replace(s, '_', '-') || ' of ' || s, 'show ' || s || 's of ' || s]) AS query FROM v""",
    "cycle_budgets": """
      WITH p AS (SELECT p_partkey, p_partkey * 1499 % 200000 AS t, p_size % 3 + 1 AS k, ['8k', '32k', '128k'][p_partkey % 3 + 1] AS z FROM part),
      q AS (SELECT *, z = '128k' AND t >= 131072 AS large, z = '32k' AND t >= 32768 AS middle, floor(t * 0.9)::BIGINT AS main FROM p),
      w AS (SELECT *, CASE WHEN large OR k = 1 THEN 0 WHEN middle THEN 1500 ELSE least(1500, floor(main * 0.05)) END::BIGINT AS win FROM q)
      SELECT p_partkey, CASE WHEN large THEN main WHEN middle THEN 28000 ELSE main - win END AS code_analysis, win AS "window",
             CASE WHEN large OR NOT middle THEN floor(t * 0.1) WHEN k = 1 THEN 1500 ELSE greatest(0, main - 29500) END::BIGINT AS internal FROM w""",
    "exchange_summaries": rf"""
      WITH c AS (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      u AS (SELECT conv_id, turn, text, coalesce(answer, '') AS a, text || chr(10) || coalesce(answer, '') AS b, {_INTENT} AS intent FROM c WHERE role = 'user'),
      e AS (SELECT *, list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x)) AS parts, list_transform(regexp_split_to_array(a, '\.')[1:3], lambda x: trim(x)) AS says,
                   list_concat({_ENTITY['file']}, list_concat({_ENTITY['class']}, list_concat({_ENTITY['function']}, list_concat({_ENTITY['error']}, {_ENTITY['module']})))) AS found FROM u),
      f AS (SELECT *, coalesce(list_filter(parts, lambda x: len(x) > 10 AND NOT regexp_matches(lower(x), 'hola|hello|buenos|good'))[1], text) AS first, list_filter(found, lambda x, i: list_position(found, x) = i)[1:4] AS key,
                   coalesce(list_filter(says, lambda x: regexp_matches(lower(x), '{context.ACTIONS}'))[1], CASE WHEN len(says[1]) > 10 THEN says[1] END) AS action FROM e)
      SELECT conv_id, turn, concat_ws(' | ', CASE WHEN intent <> 'general' THEN '[' || upper(intent) || ']' END, 'User: ' || CASE WHEN len(first) > 60 THEN substr(first, 1, 60) || '...' ELSE first END,
             CASE WHEN len(key) > 0 THEN 'Context: ' || array_to_string(key, ', ') END, 'Answer: ' || substr(action, 1, 60)) AS summary FROM f""",
    "token_budget": """SELECT conv_id, turn, (CASE role WHEN 'user' THEN 6553 WHEN 'system' THEN 24576 ELSE 3276 END)::BIGINT AS response, (CASE role WHEN 'user' THEN 3276 WHEN 'system' THEN 1638 ELSE 2949 END)::BIGINT AS system,
      (CASE role WHEN 'user' THEN 16384 WHEN 'system' THEN 4915 ELSE 17694 END)::BIGINT AS rag, (CASE role WHEN 'user' THEN 6553 WHEN 'system' THEN 1638 ELSE 8847 END)::BIGINT AS history FROM conversations""",
    "budget_rebalance": "WITH n AS (SELECT o_custkey AS budget_id, o_orderpriority AS category, count(*) AS k FROM orders GROUP BY ALL) SELECT budget_id, category, floor(10000 * (k / sum(k) OVER (PARTITION BY budget_id)))::BIGINT AS tokens FROM n",
    "messages_that_fit": """
      WITH RECURSIVE m AS (SELECT conv_id, turn, length(text) // 4 AS t, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 0 WHEN role = 'system' THEN 1 ELSE 2 END AS r FROM conversations),
      o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r, CASE WHEN r = 1 THEN turn ELSE -turn END) AS k FROM m),
      w AS (SELECT conv_id, turn, k, t <= 60 AS ok, CASE WHEN t <= 60 THEN t ELSE 0 END AS used FROM o WHERE k = 1
        UNION ALL SELECT o.conv_id, o.turn, o.k, w.used + o.t <= 60, CASE WHEN w.used + o.t <= 60 THEN w.used + o.t ELSE w.used END FROM w JOIN o ON o.conv_id = w.conv_id AND o.k = w.k + 1)
      SELECT conv_id, turn FROM w WHERE ok""",
    "search_texts": """
      SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '<' || lower(p_brand) || '> imports: ' || array_to_string(string_split(p_name, ' ')[1:5], ', ') || ' tags: ' || string_split(p_name, ' ')[1] ELSE 'Name: ' || p_name END
        || CASE WHEN p_size > 25 THEN ' Summary: ' || p_type ELSE '' END || ' ' || p_brand AS text FROM part""",
    "finding_categories": f"""WITH {_F} SELECT category, ['BUG_RISK', 'PATTERN', 'PATTERN', 'ARCHITECTURE', 'PATTERN', 'PATTERN'][id % 6 + 1] AS kind, CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH') THEN 'HIGH' WHEN severity = 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS impact, count(*) AS n FROM g GROUP BY ALL""",
    "finding_carryover": f"""WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE upper(severity) WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, id) AS k FROM g)
      SELECT id, category, severity FROM r WHERE (category IN ('bugs', 'security') AND severity = 'CRITICAL') OR (category = 'architecture' AND k <= 3)""",
    "analysis_gate": f"""WITH c AS (SELECT *, lower(text || CASE WHEN conv_id % 2 = 0 THEN ' fix' ELSE '' END) AS m, turn * 1.3 + 5 AS level FROM conversations)
      SELECT conv_id, turn, conv_id % 5 <> 0 AND (level > 9.5 OR (level > 7.5 AND ({_CODE}) AND turn % 3 = 0)) AS suggest FROM c""",
    "fatigue_triggers": f"""WITH {H._C}, t AS (SELECT unnest(list_filter([CASE WHEN conflicts > 3 THEN 'high_conflicts' END, CASE WHEN last_30 > 20 AND stability < 0.3 THEN 'rapid_changes' END], lambda x: x IS NOT NULL)) AS trigger, path::VARCHAR AS path FROM v LEFT JOIN s2 USING (path)),
      k AS (SELECT *, row_number() OVER (PARTITION BY trigger ORDER BY path) AS k FROM t) SELECT trigger, count(*) AS n, string_agg(path, ',' ORDER BY path) FILTER (k <= 3) AS files FROM k GROUP BY trigger""",
    "fatigue_explained": f"""WITH f AS ({H.SQL['fatigue_score']}), r AS (SELECT *, array_to_string(list_filter([CASE WHEN instability * 3 > 1.5 THEN 'unstable files with frequent changes' END, CASE WHEN activity * 3 > 2 THEN 'high recent code activity' END,
        CASE WHEN volatility * 2 > 1 THEN 'high code volatility' END, CASE WHEN architecture > 0.5 THEN 'architectural changes detected' END, CASE WHEN time > 0.5 THEN 'time since last optimization' END], lambda x: x IS NOT NULL), ', ') AS why FROM f)
      SELECT CASE WHEN why = '' THEN 'Stable system with normal activity' ELSE 'Fatigue level ' || printf('%.1f', fatigue) || ' due to: ' || why END AS explanation,
        CASE WHEN fatigue < 3 THEN 'System optimized, no action required' WHEN fatigue < 5 THEN 'Good performance, optimization not urgent' WHEN fatigue < 7 THEN 'Consider optimization soon for better performance'
             WHEN fatigue < 9 THEN 'Optimization recommended - notable degradation' ELSE 'Urgent optimization - significantly degraded performance' END AS recommendation,
        round(fatigue * 0.3::DOUBLE, 6) AS reduced, round(fatigue, 6) AS model FROM r""",
    "cross_scores": r"""
      WITH p AS (SELECT q.conv_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(q.text), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(t.text), '\s+'), lambda x: x <> '')) AS b
                 FROM conversations q JOIN conversations t ON q.conv_id = t.conv_id AND q.role = 'user' AND t.role = 'assistant'
                 QUALIFY row_number() OVER (PARTITION BY q.conv_id ORDER BY t.turn DESC, t.text) <= 100)
      SELECT query_id, count(*) AS n, round(max(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END), 6) AS best FROM p GROUP BY query_id""",
    "embed_texts": "SELECT DISTINCT sha256(text) AS key, 64 AS dim, 1.0::DOUBLE AS norm FROM documents",
}
QUERIES = {
    f.__name__: f
    for f in (
        token_budget, budget_rebalance, messages_that_fit, exchange_summaries, query_expansion, cycle_budgets, search_texts, finding_categories, finding_carryover, fatigue_explained,
        fatigue_triggers, analysis_gate, embed_texts, cross_scores,
    )
}
