"""Keyed tables that are updated in place, as versions of sorted runs.

Each write adds a run of rows dealt to buckets by a hash of the key and sorted by it; a key's
latest run counts.  Lookups open the buckets of their keys only; ``compacted`` folds all runs
into one.  A version appears when its run is whole (``versions.Versions``), so a failed writer
leaves the old one, and of two writers from one version the second gets a conflict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import small, stored
from .versions import Versions


def json_set(old: Column, new: Column) -> Column:
    """``old``, a JSON object, with the fields of ``new`` in place of its own; what is no object
    counts as empty, and null stays null if both are."""
    empty = F.expr("cast(map() as map<string,variant>)")
    a, b = (F.coalesce(F.from_json(c, "map<string,variant>"), empty) for c in (old, new))
    both = F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return F.when(old.isNull() & new.isNull(), None).otherwise(F.to_json(both))


class KeyedTable:
    """The table under ``path`` with columns ``schema`` (names and types), one row for each ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 16) -> None:
        self.versions, self.key, self.buckets = Versions(spark, path), key, buckets
        self.types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema.fields}
        self.columns = list(self.types)
        self.schema = f"{schema}, gone boolean, bucket int"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _runs(self) -> DataFrame:
        return self.versions.tables("rows", self.schema, column="run")

    def _write(self, rows: DataFrame) -> str:
        run = self.versions.fresh()
        dealt = rows.select(*[F.col(c).cast(t).alias(c) for c, t in self.types.items()], "gone").select("*", self._bucket()).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.partitionBy("bucket").parquet(f"{run}/rows")
        return run

    def _added(self, rows: DataFrame) -> int:
        version = self.versions.current()
        return self.versions.publish([*self.versions.runs(version), self._write(rows)], version)

    def _latest(self, rows: DataFrame) -> DataFrame:
        last = rows.groupBy(self.key).agg(F.max_by(F.struct("gone", *[c for c in self.columns if c != self.key]), "run").alias("x"))
        return last.where("not x.gone").select(self.key, "x.*").select(*self.columns)

    def read(self) -> DataFrame:
        """All rows as they are now."""
        return self._latest(self._runs())

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``, from their buckets alone."""
        asked = keys.select(self.key).distinct()
        opened = [r[0] for r in asked.select(self._bucket()).distinct().collect()]  # the table's buckets at most
        return self._latest(self._runs().where(F.col("bucket").isin(opened)).join(small(asked, 64), self.key))

    def put(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows added or replaced whole; of several with one key the last by ``order``."""
        if order:
            rest = F.struct(*[c for c in self.columns if c != self.key])
            rows = rows.groupBy(self.key).agg(F.max_by(rest, order).alias("x")).select(self.key, "x.*")
        return self._added(rows.withColumn("gone", F.lit(False)))

    def delete(self, keys: DataFrame) -> int:
        none = [F.lit(None).alias(c) for c in self.columns if c != self.key]
        return self._added(keys.select(self.key).distinct().select(self.key, *none, F.lit(True).alias("gone")))

    def patch(self, rows: DataFrame, json: list[str] = ()) -> int:
        """Columns of ``rows`` that are not null replace those of rows that exist, fields of ``json``
        columns one by one; other keys are left alone.  Keys must be unique."""
        side = [c for c in rows.columns if c != self.key]
        new = stored(rows.select(self.key, *[F.col(c).alias(f"__{c}") for c in side]), "patch")
        both = self.get(new).join(new, self.key)
        value = lambda c: json_set(F.col(c), F.col(f"__{c}")) if c in json else F.coalesce(f"__{c}", c)
        return self._added(both.select(self.key, *[(value(c) if c in side else F.col(c)).alias(c) for c in self.columns if c != self.key], F.lit(False).alias("gone")))

    def compacted(self) -> int:
        """The next version: one run of all that is there."""
        version = self.versions.current()
        return self.versions.publish([self._write(self.read().withColumn("gone", F.lit(False)))], version)
