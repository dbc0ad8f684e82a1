"""The weighted code graph: upserts, neighbours, impact, patterns and decay.

Nodes have ``id``; edges ``source_id, target_id, relation_type, strength`` and
``last_reinforced``.  Joins are on equal keys only: what needs a neighbour in either
direction uses the list of both directions, and counts are taken before joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import age_in_days
from ..session import dealt, parts, shuffled, stored

#: Relation types (fixed values).
RELATIONS = ("IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "USES", "MODIFIES_TOGETHER", "BUG_PATTERN", "CONTAINS")


def observed(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges after observations ``source_id, target_id, relation_type, seen_at``: a new edge
    starts at 0.5 and each further observation adds 0.1, up to 1."""
    keys = ["source_id", "target_id", "relation_type"]
    seen = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("seen_at").alias("last_reinforced"))
    if existing is None:
        return seen.withColumn("strength", F.least(F.lit(1.0), 0.5 + 0.1 * (F.col("n") - 1)))
    old = existing.select(*keys, F.col("strength").alias("s0"), F.col("last_reinforced").alias("t0"))
    both = old.join(seen, keys, "full_outer")
    n = F.coalesce("n", F.lit(0))
    strength = F.when(F.col("s0").isNull(), 0.5 + 0.1 * (n - 1)).otherwise(F.col("s0") + 0.1 * n)
    return both.select(*keys, n.alias("n"), F.greatest("last_reinforced", "t0").alias("last_reinforced"), F.least(F.lit(1.0), strength).alias("strength"))


def upserted(nodes: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both tables, of equal keys the latest by ``order``."""
    both = nodes.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("row"))
    return latest.select(*keys, "row.*")


def strengthened(edges: DataFrame, deltas: DataFrame) -> DataFrame:
    """Edges plus the sum of their ``delta``, at most 1."""
    keys = ["source_id", "target_id", "relation_type"]
    sums = deltas.groupBy(*keys).agg(F.sum("delta").alias("d"))
    return edges.join(sums, keys, "left").withColumn("strength", F.least(F.lit(1.0), F.col("strength") + F.coalesce("d", F.lit(0.0)))).drop("d")


def both_ways(edges: DataFrame) -> DataFrame:
    """``node, neighbor, direction`` and the edge's columns, once from either end."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbor"), F.lit("outgoing").alias("direction"), *rest)
    back = edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbor"), F.lit("incoming").alias("direction"), *rest)
    return out.unionByName(back)


def related(edges: DataFrame, seeds: DataFrame, depth: int = 2, least: float = 0.3) -> DataFrame:
    """``seed, node, distance, strength`` within ``depth`` steps of each seed: strengths
    multiply along a path.  Each level keeps a node's best path; a node found at one level
    is not visited again, one that was too weak may be.  Edges and levels are written as they
    are found, so no level computes those before it again."""
    hops = stored(both_ways(edges).groupBy("node", "neighbor").agg(F.max("strength").alias("s")), "hops")
    front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance"), F.lit(1.0).alias("strength"))
    seen = front
    for level in range(1, depth + 1):
        step = front.join(hops, "node").select("seed", F.col("neighbor").alias("node"), (F.col("strength") * F.col("s")).alias("strength"))
        step = step.where(F.col("strength") >= least).groupBy("seed", "node").agg(F.max("strength").alias("strength"))
        front = stored(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(level).alias("distance"), "strength"), "level")
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def dependents(edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """Edges into a node, as ``node`` (the one depended on) and ``dependent``."""
    e = edges.where(F.col("relation_type").isin(relations)) if relations else edges
    return e.select(F.col("target_id").alias("node"), F.col("source_id").alias("dependent"), "relation_type", "strength")


def impact(edges: DataFrame) -> DataFrame:
    """For each node how many dependents a change hits strongly (over 0.7), fairly (over
    0.4) and slightly, and the strongest of them."""
    best = dependents(edges).groupBy("node", "dependent").agg(F.max("strength").alias("s"))
    level = F.when(F.col("s") > 0.7, "high").when(F.col("s") > 0.4, "medium").otherwise("low")
    rows = best.withColumn("level", level)
    return rows.groupBy("node").agg(
        *[F.count_if(F.col("level") == x).alias(x) for x in ("high", "medium", "low")], F.count("*").alias("total"),
        F.max(F.struct("s", "dependent"))["dependent"].alias("strongest"),
    )


def dependencies(edges: DataFrame) -> DataFrame:
    """For each source and relation its targets in order, and their mean strength."""
    return edges.groupBy("source_id", "relation_type").agg(
        F.count("*").alias("n"), F.round(F.avg("strength"), 6).alias("avg_strength"), F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias("targets")
    )


def co_modified(items: DataFrame, commit: str, file: str, k: int = 10, least: int = 1) -> DataFrame:
    """Files changed together: ``file, other, together, frequency`` (of all commits), the
    ``k`` most frequent partners of each file."""
    from .pairs import best_partners, group_sizes

    n = parts(items)
    rows = items.select(F.col(commit).alias("c"), F.col(file).alias("file"))
    once = stored(dealt(rows, n, "c", "file").distinct(), "changes")  # read several times below
    other = once.withColumnRenamed("file", "other")
    sizes = stored(group_sizes(once, other), "sizes")
    total = sizes.agg(F.count("c").alias("total"))
    best = best_partners(once, other, k, least, sizes, mirrored=True)
    return best.crossJoin(F.broadcast(total)).select("file", "other", "together", (F.col("together") / F.col("total")).alias("frequency"))  # one row


#: Files that change with everything (fixed values).
COMMON = (".gitignore", "package.json", "pyproject.toml", "requirements", "readme", ".lock")


def changed_with(changes: DataFrame, commit: str, file: str, order: str, commits: int = 50, k: int = 5, least: int = 2) -> DataFrame:
    """``file, other, together``: what each file's latest ``commits`` also changed, the ``k`` most
    frequent of it, if together at least so often; common files are no partners."""
    from .pairs import best_partners
    from .search import top

    n = parts(changes)
    rows = dealt(changes.select(F.col(commit).alias("c"), F.col(file).alias("file"), F.col(order).alias("at")), n, "c", "file")
    once = stored(rows.groupBy("c", "file").agg(F.max("at").alias("at")), "changes")  # read several times below
    with shuffled(changes.sparkSession, n):
        recent = stored(top(dealt(once, n, "file", "c"), commits, F.desc("at"), F.desc("c"), by="file").select("c", "file"), "recent")
    partner = F.lit(True)
    for part in COMMON:
        partner &= ~F.contains(F.lower("other"), F.lit(part))
    return best_partners(recent, once.select("c", F.col("file").alias("other")).where(partner), k, least)


def resolved(refs: DataFrame, nodes: DataFrame, ref: str = "ref") -> DataFrame:
    """``refs`` and the ``node_id`` that each means: 32 hexadecimal digits are an id, which must
    exist, anything else is a path; null if unknown."""
    is_id = F.col(ref).rlike("^[0-9a-f]{32}$")
    names = nodes.select(F.col("id").alias("__k"), F.lit(True).alias("__by_id"), F.col("id").alias("node_id")).unionByName(nodes.select(F.col("path").alias("__k"), F.lit(False).alias("__by_id"), F.col("id").alias("node_id")))
    names = names.groupBy("__k", "__by_id").agg(F.min("node_id").alias("node_id"))
    return refs.join(names, (F.col(ref) == F.col("__k")) & (is_id == F.col("__by_id")), "left").drop("__k", "__by_id")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, connections``: edges at either end; a node without any counts one, as a left
    join with a row count would give."""
    n = both_ways(edges).groupBy("node").agg(F.count("*").alias("k"))
    return nodes.select("id").join(n, F.col("id") == F.col("node"), "left").select("id", F.coalesce("k", F.lit(1)).alias("connections"))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean connections of a node."""
    n = degrees(nodes, edges).agg(F.count("*").alias("total_nodes"), F.avg("connections").alias("avg_connectivity"))
    return n.crossJoin(edges.agg(F.count("*").alias("total_edges")))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct partners and mean strengths of each node, outwards and inwards."""

    def side(this: str, other: str, name: str) -> DataFrame:
        return edges.groupBy(F.col(this).alias("id")).agg(F.count_distinct(other).alias(f"{name}_degree"), F.avg("strength").alias(f"{name}_strength"))

    rows = nodes.select("id").join(side("source_id", "target_id", "out"), "id", "left").join(side("target_id", "source_id", "in"), "id", "left")
    return rows.fillna(0, ["out_degree", "in_degree"]).fillna(0.0, ["out_strength", "in_strength"])


def clusters(edges: DataFrame, least_edges: int = 3, least_strength: float = 0.6, k: int = 10) -> DataFrame:
    """The ``k`` nodes with most distinct neighbours in each direction among those with
    enough strong edges, with their neighbours."""
    edges = stored(edges, "edges")  # read twice below
    ways = dealt(both_ways(edges), 2 * parts(edges), "node")
    partner = [F.count_distinct(F.when(F.col("direction") == d, F.col("neighbor"))) for d in ("outgoing", "incoming")]
    one = ways.groupBy("node").agg((partner[0] + partner[1]).alias("connections"), F.avg("strength").alias("avg_strength"))
    good = one.where((F.col("connections") >= least_edges) & (F.col("avg_strength") >= least_strength))
    best = good.orderBy(F.desc("connections"), F.desc(F.round("avg_strength", 9)), "node").limit(k)
    members = ways.join(F.broadcast(best.select("node")), "node").groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("neighbor")), ",").alias("members"))
    return best.join(members, "node")


def tight_coupling(edges: DataFrame, least: float = 0.8, relations: int = 3) -> DataFrame:
    """Pairs tied by several strong relations; HIGH above a mean of 0.9, else MEDIUM."""
    found = edges.where(F.col("strength") >= least).groupBy("source_id", "target_id").agg(
        F.count_distinct("relation_type").alias("relations"), F.avg("strength").alias("avg_strength"), F.array_join(F.array_sort(F.collect_list("relation_type")), ",").alias("relation_types"),
    )
    return found.where(F.col("relations") >= relations).withColumn("severity", F.when(F.col("avg_strength") > 0.9, "HIGH").otherwise("MEDIUM"))


def hotspots(changes: DataFrame, as_of, days: int = 30, least: int = 10, critical: int = 20) -> DataFrame:
    """Files with many distinct commits in the last days; ``changes`` has ``file, commit,
    partner, ts``."""
    recent = changes.where(age_in_days(F.col("ts"), F.lit(as_of)).between(0, days))
    n = recent.groupBy("file").agg(F.count_distinct("commit").alias("modifications"), F.count_distinct("partner").alias("partners"))
    return n.where(F.col("modifications") >= least).withColumn("severity", F.when(F.col("modifications") > critical, "CRITICAL").otherwise("HIGH"))


def recurring(rows: DataFrame, group: str, least: int = 2, high: int = 5) -> DataFrame:
    """Edges that share a pattern: count, instances ``a -> b`` in order, severity."""
    instance = F.concat_ws(" -> ", "source_id", "target_id")
    n = rows.groupBy(group).agg(F.count("*").alias("occurrences"), F.array_join(F.array_sort(F.collect_list(instance)), "; ").alias("instances"))
    return n.where(F.col("occurrences") >= least).withColumn("severity", F.when(F.col("occurrences") > high, "HIGH").otherwise("MEDIUM"))


def layer_violations(edges: DataFrame, nodes: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Edges from a path with one part to a path with another that the rules forbid."""
    a, b = (nodes.select(F.col("id").alias(f"{x}_id"), F.col("path").alias(f"{x}_path")) for x in ("source", "target"))
    found = F.lit(False)
    for low, high in rules:
        found |= F.col("source_path").contains(low) & F.col("target_path").contains(high)
    return edges.join(a, "source_id").join(b, "target_id").where(found)


def decayed(edges: DataFrame, as_of, relations: list[str], days: int = 30, step: float = 0.05, floor: float = 0.1) -> DataFrame:
    """Edges of the relations that are older than the days lose a step, down to the floor;
    ``affected`` marks them."""
    old = F.col("relation_type").isin(relations) & (F.col("last_reinforced").cast("timestamp") < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
    return edges.withColumn("affected", old).withColumn("strength", F.when(old, F.greatest(F.lit(floor), F.col("strength") - step)).otherwise(F.col("strength")))
