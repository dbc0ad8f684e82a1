"""Graph queries over parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph
from ..session import dealt, parts
from .tables import EDGES_SQL, edges, load


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return p.union(load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")))


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("source_id", "target_id", "relation_type", F.round("strength", 6).alias("strength"), "n", F.date_format(F.col("last_reinforced").cast("timestamp"), "yyyy-MM-dd").alias("last_seen"))


def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.lit("USES").alias("relation_type"), F.col("l_shipdate").alias("seen_at"), "l_linestatus")
    old = graph.observed(rows.where("l_linestatus = 'F'").drop("l_linestatus"))
    new = graph.observed(rows.where("l_linestatus <> 'F'").drop("l_linestatus"), old)
    return new.select("source_id", "target_id", F.round("strength", 6).alias("strength"))


def edge_strengthen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    deltas = load(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.col("l_returnflag").alias("relation_type"), F.lit(0.1).alias("delta"))
    return graph.strengthened(e, deltas).select("source_id", "target_id", "relation_type", F.round("strength", 6).alias("strength"))


def undirected_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.both_ways(edges(spark, sf_dir).where("strength >= 0.6"))
    return rows.select("node", "neighbor", "direction", "relation_type", F.round("strength", 6).alias("strength"))


def bfs_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = load(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("seed"))
    return graph.related(edges(spark, sf_dir), seeds, 2, 0.3).select("seed", "node", "distance", F.round("strength", 6).alias("strength"))


def impact_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(edges(spark, sf_dir))


def file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependencies(edges(spark, sf_dir))


def co_modified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.co_modified(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 10)
    return rows.select("file", "other", "together", F.round("frequency", 9).alias("frequency"))


def supplied_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that the same suppliers have delivered: groups of hundreds to thousands of parts, which
    are dealt to blocks."""
    rows = graph.co_modified(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", 3, 2)
    return rows.select("file", "other", "together", F.round("frequency", 9).alias("frequency"))


def changed_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.when(F.col("l_partkey") % 9 == 0, "README").otherwise("src/p"), F.col("l_partkey").cast("string")).alias("file"), "l_shipdate")
    return graph.changed_with(li, "l_orderkey", "file", "l_shipdate", 20, 5, 2)


def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by id, by path, and by ids and paths that are not there."""
    p = load(spark, sf_dir, "part")
    key = F.md5(F.col("p_partkey").cast("string").cast("binary"))
    nodes = p.where("p_partkey % 5 <> 0").select(key.alias("id"), F.concat(F.lit("src/"), "p_partkey").alias("path"))
    refs = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, key).otherwise(F.concat(F.lit("src/"), "p_partkey")).alias("ref"))
    return graph.resolved(refs, nodes)


def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.graph_metrics(_nodes(spark, sf_dir), edges(spark, sf_dir))
    return rows.select("total_nodes", "total_edges", F.round("avg_connectivity", 6).alias("avg_connectivity"))


def node_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.connectivity(_nodes(spark, sf_dir), edges(spark, sf_dir))
    return rows.select("id", "out_degree", "in_degree", F.round("out_strength", 6).alias("out_strength"), F.round("in_strength", 6).alias("in_strength"))


def strong_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.clusters(edges(spark, sf_dir), 3, 0.5)
    return rows.select("node", "connections", F.round("avg_strength", 6).alias("avg_strength"), "members")


def tight_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.tight_coupling(edges(spark, sf_dir), 0.5, 3)
    return rows.select("source_id", "target_id", "relations", F.round("avg_strength", 6).alias("avg_strength"), "relation_types", "severity")


def change_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    n = parts(li)
    rows = dealt(li, n, "l_orderkey").join(dealt(o, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("partner"), F.col("o_orderdate").alias("ts"))
    return graph.hotspots(rows, "1998-06-01 00:00:00")


def recurring_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.recurring(edges(spark, sf_dir).withColumn("pattern", F.concat_ws("/", "relation_type", F.date_format(F.col("last_reinforced").cast("timestamp"), "yyyy-MM-dd"))), "pattern")


def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("/src"), F.element_at(F.array(F.lit("/domain/"), F.lit("/infra/"), F.lit("/api/")), (F.col("n_nationkey") % 3 + 1).cast("int")), "n_name").alias("path"))
    e = c.select(F.col("c_nationkey").cast("string").alias("source_id"), (F.col("c_custkey") % 25).cast("string").alias("target_id"), "c_custkey")
    rows = graph.layer_violations(e, nodes, [("/domain/", "/infra/"), ("/domain/", "/api/"), ("/infra/", "/api/")])
    return rows.select("c_custkey", "source_path", "target_path")


def pattern_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [tight_coupling(spark, sf_dir), change_hotspots(spark, sf_dir), recurring_patterns(spark, sf_dir), layer_violations(spark, sf_dir).withColumn("severity", F.lit("HIGH"))]
    names = ["tight_coupling", "change_hotspot", "recurring_bug", "layer_violation"]
    rows = None
    for name, part in zip(names, parts):
        one = part.select(F.lit(name).alias("pattern_type"), "severity")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("pattern_type", "severity").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))


def edge_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.decayed(edges(spark, sf_dir), "2000-01-01 00:00:00", ["A", "N"])
    return rows.select("source_id", "target_id", "relation_type", F.round("strength", 6).alias("strength"), "affected")


_BOTH = """both_ways AS (
  SELECT source_id AS node, target_id AS neighbor, 'outgoing' AS direction, relation_type, strength FROM edges
  UNION ALL SELECT target_id, source_id, 'incoming', relation_type, strength FROM edges)"""
_NODES = "nodes AS (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier)"
_TIGHT = """SELECT source_id, target_id, count(DISTINCT relation_type) AS relations, round(avg(strength), 6) AS avg_strength,
  string_agg(relation_type, ',' ORDER BY relation_type) AS relation_types, CASE WHEN avg(strength) > 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM edges WHERE strength >= 0.5 GROUP BY ALL HAVING count(DISTINCT relation_type) >= 3"""
_HOT = """SELECT l_suppkey AS file, count(DISTINCT l_orderkey) AS modifications, count(DISTINCT l_partkey) AS partners,
  CASE WHEN count(DISTINCT l_orderkey) > 20 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE floor(epoch(TIMESTAMP '1998-06-01' - o_orderdate) / 86400) BETWEEN 0 AND 30
  GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 10"""
_RECUR = """SELECT relation_type || '/' || strftime(last_reinforced, '%Y-%m-%d') AS pattern, count(*) AS occurrences,
  string_agg(source_id || ' -> ' || target_id, '; ' ORDER BY source_id || ' -> ' || target_id) AS instances, CASE WHEN count(*) > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM edges GROUP BY 1 HAVING count(*) >= 2"""
_LAYER = """SELECT c_custkey, a.path AS source_path, b.path AS target_path FROM customer
  JOIN ln a ON a.id = c_nationkey JOIN ln b ON b.id = c_custkey % 25
  WHERE (contains(a.path, '/domain/') AND contains(b.path, '/infra/')) OR (contains(a.path, '/domain/') AND contains(b.path, '/api/')) OR (contains(a.path, '/infra/') AND contains(b.path, '/api/'))"""
_LN = "ln AS (SELECT n_nationkey AS id, '/src' || ['/domain/', '/infra/', '/api/'][n_nationkey % 3 + 1] || n_name AS path FROM nation)"
SQL = {
    "edge_upsert": f"WITH {EDGES_SQL} SELECT source_id, target_id, relation_type, round(strength, 6) AS strength, n, strftime(last_reinforced, '%Y-%m-%d') AS last_seen FROM edges",
    "edge_merge": """
      WITH o AS (SELECT l_partkey, l_suppkey, count(*) FILTER (l_linestatus = 'F') AS n0, count(*) FILTER (l_linestatus <> 'F') AS n1 FROM lineitem GROUP BY ALL)
      SELECT 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id,
             round(CASE WHEN n0 = 0 THEN least(1.0, 0.5 + 0.1 * (n1 - 1)) ELSE least(1.0, least(1.0, 0.5 + 0.1 * (n0 - 1)) + 0.1 * n1) END::DOUBLE, 6) AS strength FROM o""",
    "edge_strengthen": f"""WITH {EDGES_SQL}, d AS (SELECT 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id, l_returnflag AS relation_type, count(*) * 0.1 AS d FROM lineitem WHERE l_quantity > 40 GROUP BY ALL)
      SELECT source_id, target_id, relation_type, round(least(1.0, strength + coalesce(d, 0)), 6) AS strength FROM edges LEFT JOIN d USING (source_id, target_id, relation_type)""",
    "undirected_neighbors": f"WITH {EDGES_SQL}, {_BOTH} SELECT node, neighbor, direction, relation_type, round(strength, 6) AS strength FROM both_ways WHERE strength >= 0.6",
    "bfs_related": f"""WITH {EDGES_SQL}, {_BOTH}, hops AS (SELECT node, neighbor, max(strength) AS s FROM both_ways GROUP BY ALL),
      one AS (SELECT node AS seed, neighbor AS node, s FROM hops WHERE node IN (SELECT 'p' || p_partkey FROM part WHERE p_partkey % 50 = 0) AND s >= 0.3),
      two AS (SELECT seed, neighbor AS node, max(one.s * hops.s) AS s FROM one JOIN hops ON one.node = hops.node WHERE one.s * hops.s >= 0.3 GROUP BY ALL)
      SELECT seed, node, 1 AS distance, round(s, 6) AS strength FROM one
      UNION ALL SELECT seed, node, 2, round(s, 6) FROM two t WHERE node <> seed AND NOT EXISTS (SELECT 1 FROM one WHERE one.seed = t.seed AND one.node = t.node)""",
    "impact_buckets": f"""WITH {EDGES_SQL}, b AS (SELECT target_id AS node, source_id AS dependent, max(strength) AS s FROM edges GROUP BY ALL)
      SELECT node, count_if(s > 0.7)::BIGINT AS high, count_if(s > 0.4 AND s <= 0.7)::BIGINT AS medium, count_if(s <= 0.4)::BIGINT AS low, count(*) AS total, max({{'s': s, 'd': dependent}}).d AS strongest FROM b GROUP BY node""",
    "file_dependencies": f"""WITH {EDGES_SQL} SELECT source_id, relation_type, count(*) AS n, round(avg(strength), 6) AS avg_strength, string_agg(target_id, ',' ORDER BY target_id) AS targets FROM edges GROUP BY source_id, relation_type""",
    "changed_with": """
      WITH o AS (SELECT l_orderkey AS c, CASE WHEN l_partkey % 9 = 0 THEN 'README' ELSE 'src/p' END || l_partkey AS file, max(l_shipdate) AS d FROM lineitem GROUP BY ALL),
      r AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY file ORDER BY d DESC, c DESC) <= 20),
      k AS (SELECT r.file, o.file AS other, count(*) AS together FROM r JOIN o ON r.c = o.c AND r.file <> o.file AND o.file NOT LIKE 'README%' GROUP BY ALL)
      SELECT * FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY file ORDER BY together DESC, other) <= 5) WHERE together >= 2""",
    "node_lookup": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN md5(p_partkey::VARCHAR) ELSE 'src/' || p_partkey END AS ref, CASE WHEN p_partkey % 5 <> 0 THEN md5(p_partkey::VARCHAR) END AS node_id FROM part",
    "co_modified_pairs": """
      WITH o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
      c AS (SELECT a.l_partkey AS file, b.l_partkey AS other, count(*) AS together FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY together DESC, other) AS rank FROM c)
      SELECT file, other, together, round(together / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 9) AS frequency FROM r WHERE rank <= 10""",
    "supplied_together": """
      WITH o AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
      c AS (SELECT a.l_partkey AS file, b.l_partkey AS other, count(*) AS together FROM o a JOIN o b ON a.l_suppkey = b.l_suppkey AND a.l_partkey <> b.l_partkey GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY together DESC, other) AS rank FROM c WHERE together >= 2)
      SELECT file, other, together, round(together / (SELECT count(DISTINCT l_suppkey) FROM lineitem), 9) AS frequency FROM r WHERE rank <= 3""",
    "graph_metrics": f"""WITH {EDGES_SQL}, {_BOTH}, {_NODES}, d AS (SELECT id, greatest(count(node), 1) AS k FROM nodes LEFT JOIN both_ways ON id = node GROUP BY id)
      SELECT count(*) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, round(avg(k), 6) AS avg_connectivity FROM d""",
    "node_connectivity": f"""WITH {EDGES_SQL}, {_NODES},
      o AS (SELECT source_id AS id, count(DISTINCT target_id) AS d, avg(strength) AS s FROM edges GROUP BY 1), i AS (SELECT target_id AS id, count(DISTINCT source_id) AS d, avg(strength) AS s FROM edges GROUP BY 1)
      SELECT n.id, coalesce(o.d, 0) AS out_degree, coalesce(i.d, 0) AS in_degree, round(coalesce(o.s, 0), 6) AS out_strength, round(coalesce(i.s, 0), 6) AS in_strength FROM nodes n LEFT JOIN o USING (id) LEFT JOIN i ON n.id = i.id""",
    "strong_clusters": f"""WITH {EDGES_SQL}, {_BOTH},
      c AS (SELECT node, count(DISTINCT neighbor) FILTER (direction = 'outgoing') + count(DISTINCT neighbor) FILTER (direction = 'incoming') AS connections, avg(strength) AS a, string_agg(DISTINCT neighbor, ',' ORDER BY neighbor) AS members FROM both_ways GROUP BY node)
      SELECT node, connections, round(a, 6) AS avg_strength, members FROM c WHERE connections >= 3 AND a >= 0.5 ORDER BY connections DESC, round(a, 9) DESC, node LIMIT 10""",
    "tight_coupling": f"WITH {EDGES_SQL} {_TIGHT}",
    "change_hotspots": _HOT,
    "recurring_patterns": f"WITH {EDGES_SQL} {_RECUR}",
    "layer_violations": f"WITH {_LN} {_LAYER}",
    "pattern_report": f"""WITH {EDGES_SQL}, {_LN}, t AS ({_TIGHT}), h AS ({_HOT}), r AS ({_RECUR}), l AS ({_LAYER}),
      u AS (SELECT 'tight_coupling' AS pattern_type, severity FROM t UNION ALL SELECT 'change_hotspot', severity FROM h UNION ALL SELECT 'recurring_bug', severity FROM r UNION ALL SELECT 'layer_violation', 'HIGH' FROM l)
      SELECT pattern_type, severity, count(*) AS n, count_if(severity = 'CRITICAL')::BIGINT AS critical FROM u GROUP BY ALL""",
    "edge_decay": f"""WITH {EDGES_SQL}, a AS (SELECT *, relation_type IN ('A', 'N') AND last_reinforced < TIMESTAMP '2000-01-01' - INTERVAL 30 DAY AS affected FROM edges)
      SELECT source_id, target_id, relation_type, round(CASE WHEN affected THEN greatest(0.1, strength - 0.05) ELSE strength END, 6) AS strength, affected FROM a""",
}

QUERIES = {
    f.__name__: f
    for f in (
        edge_upsert, edge_merge, edge_strengthen, undirected_neighbors, bfs_related, impact_buckets, file_dependencies, co_modified_pairs, supplied_together, changed_with, node_lookup, graph_metrics,
        node_connectivity, strong_clusters, tight_coupling, change_hotspots, recurring_patterns, layer_violations, pattern_report, edge_decay,
    )
}
