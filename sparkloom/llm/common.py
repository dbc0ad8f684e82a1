"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F



def fresh(names, base: str) -> str:
    """``base``, with underscores before it until no column has that name (case aside)."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base = f"_{base}"
    return base


#: Code points that end a word: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one that Spark would read in fewer tasks than there are cores (a small single
    file) is dealt to as many."""
    small_batches(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's checkpoint folder, which every executor sees.

    Where the session names none (tests on one machine) a local one is set up.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or _own_root(spark)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"


_OWN: dict[str, str] = {}


def _own_root(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all executors see in spark.checkpoint.dir")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="sparkloom-"))


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch at most: texts may be long, and a worker holds a batch several times.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows, and has workers that start
    from now on multiply matrices in one thread: a worker has one core of its executor."""
    spark.sparkContext.environment["OPENBLAS_NUM_THREADS"] = "1"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def words(text: str) -> list[bytes]:
    """Words of the ASCII-lower-cased text as UTF-8; bytes split at exactly ``SPACES``."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def id_buckets(df: DataFrame, key: str, n: int) -> list:
    """At most ``n - 1`` ascending bounds that cut ``key`` into ranges of about equal row count."""
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(key, at, max(10_000, 20 * n)).alias("b")).first()["b"]
    return sorted({x for x in got or [] if x is not None})


def bucket_of(key: Column, bounds: list) -> Column:
    """Number of bounds below ``key`` (0 for null), by binary search inside one expression."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    array = F.array(*[F.lit(b) for b in bounds])

    def step(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        low = F.element_at(array, F.least(mid, F.lit(len(bounds) - 1)) + 1) < key
        go = s["lo"] < s["hi"]
        return F.struct(
            F.when(go & low, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(go & ~low, mid).otherwise(s["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"]
    return F.when(key.isNull(), 0).otherwise(found)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A side is sent to every executor only below so many bytes; beyond, it is shuffled.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows`` rows of ``row_bytes`` stay under the bound."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: Keys held by more than this part of all rows (and by more than ``FEW``) are heavy, so at
#: most so many are; their rows are dealt to so many tasks.
HEAVY, FEW, SALTS = 4096, 64, 64


def spread_join(rows: DataFrame, side: DataFrame, key: str, uses: str, by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``side``, which has a row for each ``key`` and how many rows hold it
    (``uses``).  Rows of heavy keys, and those without a key, are dealt by the column ``by`` to
    several tasks, which get copies of the side's row.  ``counts`` gives ``key`` and ``uses`` if
    computing ``side`` is dear; what is broadcast has at most ``HEAVY`` rows."""
    counts = side if counts is None else counts
    bar = max(FEW, (counts.agg(F.sum(uses)).first()[0] or 0) // HEAVY)
    heavy = counts.where(F.col(uses) > bar).select(F.col(key).alias("__heavy"))
    zero, salt = F.lit(0).cast("long"), F.pmod(F.xxhash64(by), F.lit(SALTS))
    rows = rows.join(F.broadcast(heavy), F.col(key) == F.col("__heavy"), "left")
    rows = rows.withColumn("__salt", F.when(F.col("__heavy").isNotNull() | F.col(key).isNull(), salt).otherwise(zero)).drop("__heavy")
    every = F.sequence(zero, F.lit(SALTS - 1).cast("long"))
    side = side.withColumn("__salt", F.explode(F.when(F.col(uses) > bar, every).otherwise(F.array(zero))))
    return rows.join(side, [key, "__salt"], how).drop("__salt")


@contextlib.contextmanager
def settings(spark: SparkSession, **values):
    """Session settings (dots written as two underscores) for the statements inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def bucketed(df: DataFrame, by: str, buckets: int, path: str) -> DataFrame:
    """``df`` written to ``path`` as a table whose files are bucketed by ``by``.  Each partition
    should hold few values of it: then nothing is shuffled or sorted, and a later join on ``by``
    and other columns does not move this table (see ``aligned``)."""
    spark, name = df.sparkSession, _table(path)
    with settings(spark, spark__sql__maxConcurrentOutputFileWriters=8):
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, by).saveAsTable(name)
    return spark.table(name)


def _table(path: str) -> str:
    return "sparkloom_" + "".join(c if c.isalnum() else "_" for c in path.rpartition("sparkloom-")[2])


def discarded(spark: SparkSession, path: str) -> None:
    """Drops a table of ``bucketed`` and its files, once nothing reads it any more."""
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def aligned(spark: SparkSession):
    """Inside, a join on a bucketed table's column and others counts as aligned by the column."""
    return settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false", spark__sql__sources__bucketing__autoBucketedScan__enabled="false")
