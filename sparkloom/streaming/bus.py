"""The event bus as streams: files or memory in, one query for each subscription.

State is kept by keys and bounded by watermarks; what a batch query gives on the same rows
is the reference for tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 20) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def subscribe(stream: DataFrame, predicate: Column, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A query that hands each batch of matching events to ``handle``, once it is available."""
    return stream.where(predicate).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(stream: DataFrame, task: str, ts: str, current: str, total: str, late: str = "10 minutes") -> DataFrame:
    """Latest progress of each task."""
    seen = stream.withWatermark(ts, late).groupBy(task).agg(F.max(F.struct(ts, current, total)).alias("x"))
    return seen.select(task, F.col("x")[current].alias("current"), F.col("x")[total].alias("total"), (F.col("x")[current] * 100.0 / F.col("x")[total]).alias("percent"))


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by kind in windows of event time (an extension)."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))


def idle(stream: DataFrame, ts: str, session: str, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Connections as sessions that end after a gap without heartbeat."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), session).agg(F.count("*").alias("beats"))


def cooldown(stream: DataFrame, key: str, seconds: str, gap: float) -> DataFrame:
    """Events at least ``gap`` seconds after the last accepted one of their key; the state is
    that event's time."""
    schema = stream.select(key, seconds).schema
    kinds = [f.dataType.simpleString() for f in schema.fields]

    def accept(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = (state.get[0] if state.exists else None), []
        for t in sorted(t for b in batches for t in b[seconds]):
            if last is None or t - last >= gap:
                last = t
                out.append(t)
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), seconds: out})

    return stream.select(key, seconds).groupBy(key).applyInPandasWithState(accept, f"`{key}` {kinds[0]}, `{seconds}` {kinds[1]}", "last double", "append", GroupStateTimeout.NoTimeout)


def upsert_into(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A handler that appends each batch's latest row of a key to a change log at ``path``."""

    def handle(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in (key, order)]
        batch.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x")).select(key, "x.*").write.mode("append").parquet(path)

    return handle
