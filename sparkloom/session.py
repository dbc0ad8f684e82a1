"""Session settings the engine expects, and the bound on broadcast sides."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side goes to every executor only below this many bytes; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20
#: Rows of a partition that a task sorts or groups.
ROWS = 1 << 18


def session(name: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if a count shows it to be under the bound, else as it is."""
    limit = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def parts(df: DataFrame, rows: int | None = None) -> int:
    """How many partitions of about ``rows`` rows (``ROWS``) ``df`` makes."""
    return max(1, math.ceil(df.count() / (rows or ROWS)))


def dealt(df: DataFrame, n: int, *by: str) -> DataFrame:
    """``df`` dealt by columns to ``n`` partitions, so that what a task holds does not grow with the
    table: Spark keeps a number that is given, and operators by these columns shuffle no more.
    What fits one partition stays as it is."""
    return df.repartition(n, *by) if n > 1 else df


@contextlib.contextmanager
def shuffled(spark: SparkSession, n: int):
    """What is written inside is shuffled to ``n`` partitions, at least as many as cores, which adaptive
    execution does not merge; unlike ``dealt``, rows are still aggregated before they are shuffled.  Only
    sides so marked are broadcast: Spark goes by the size of files, of which rows may make fifty times."""
    cores = spark.sparkContext.defaultParallelism
    values = {"spark.sql.shuffle.partitions": str(max(n, cores)), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path that all executors see: below the checkpoint folder the session names, else
    below its warehouse; on one machine (tests) a temporary folder will do."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or (tempfile.mkdtemp(prefix="sparkloom-") if sc.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch path and read back: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
