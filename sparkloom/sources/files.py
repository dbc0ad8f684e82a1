"""Text files as rows, tables by name, and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import files as kinds

#: Largest file that is admitted.
MOST_BYTES = 10 << 20


def discover(spark: SparkSession, root: str, glob: str = "*", ignore: list[str] = ()) -> DataFrame:
    """``path, size_bytes, modified_at`` of admitted files below ``root``: of a known type, not
    too large, not ignored.  Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    rows = found.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return rows.where((F.col("size_bytes") <= MOST_BYTES) & kinds.supported(F.col("path")) & ~kinds.ignored(relative, list(ignore)))


def read_texts(spark: SparkSession, paths: list[str] | str, glob: str = "*") -> DataFrame:
    """``path, content, language``: whole files as UTF-8 with bad bytes dropped; blank and binary
    files are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
    content = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\uFFFD", "")
    rows = found.where(F.col("length") <= MOST_BYTES).select("path", content.alias("content"))
    rows = rows.where(F.col("content").rlike(r"\S") & ~kinds.binary(F.col("content")))
    return rows.withColumn("language", kinds.language(F.col("path")))


def stale(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files that are new or changed since they were indexed (``path, indexed_at``)."""
    both = found.join(indexed.select("path", "indexed_at"), "path", "left")
    return both.where(F.col("indexed_at").isNull() | (F.col("modified_at") > F.col("indexed_at"))).drop("indexed_at")


def append(df: DataFrame, path: str, by: list[str] = ()) -> None:
    writer = df.write.mode("append").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """A keyed table from its log: the latest row of each key."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x")).select(key, "x.*")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` with the non-null values of ``new``; unknown keys are added."""
    rest = [c for c in old.columns if c != key]
    side = new.select(key, *[F.col(c).alias(f"__{c}") for c in rest])
    return old.join(side, key, "full_outer").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in rest])


def fresh(cache: DataFrame, written_at: str, as_of, ttl_seconds: int = 3600) -> DataFrame:
    """Entries of a cache table that have not run out."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(written_at).cast("timestamp"))
    return cache.where(age <= ttl_seconds)


def cached(puts: DataFrame, changes: DataFrame, owner: str, key: str, file: str, as_of, ttl_seconds: int = 3600, most: int = 1000) -> DataFrame:
    """``owner, key`` of a result cache's entries at ``as_of``: of those put (``put_at``) that have
    not run out and whose file has not changed since (``changed_at``), each owner's latest."""
    now = F.lit(as_of).cast("timestamp")
    last = changes.where(F.col("changed_at").cast("timestamp") <= now).groupBy(file).agg(F.max("changed_at").alias("changed_at"))
    alive = fresh(puts.where(F.col("put_at").cast("timestamp") <= now), "put_at", as_of, ttl_seconds)
    valid = alive.join(last, file, "left").where(F.col("changed_at").isNull() | (F.col("changed_at") <= F.col("put_at")))
    nth = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("put_at"), F.desc(key)))
    return valid.withColumn("__nth", nth).where(F.col("__nth") <= most).select(owner, key)
