"""Test tables, and SQL that stands for them in several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import dealt, parts


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small single file whose rows
    cost much is dealt out, any other stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as a graph: an edge for each pair and return flag, observed once
    for each line."""
    from ..operators.graph import observed

    li = load(spark, sf_dir, "lineitem")
    rows = li.select(
        F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"),
        F.col("l_returnflag").alias("relation_type"), F.col("l_shipdate").alias("seen_at"),
    )
    return observed(dealt(rows, parts(li), "source_id"))


EDGES_SQL = """
edges AS (
  SELECT 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id, l_returnflag AS relation_type,
         least(1.0, 0.5 + 0.1 * (count(*) - 1))::DOUBLE AS strength, count(*) AS n, max(l_shipdate) AS last_reinforced
  FROM lineitem GROUP BY ALL
)"""
