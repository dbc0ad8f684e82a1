"""Stateful streams in order of event time, whose state ends by timers.

``in_order`` holds a key's rows until the watermark has passed them, folds them in order of
time and drops the key's state once its horizon has passed, so results do not depend on how
rows arrive and nothing is kept for a key that is quiet.  A row that comes behind the
watermark is left out and counted in the query's progress.  State lies in RocksDB, which the
session must name as its state store (``rocksdb``).
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Of a key's state: what a row does to it, with rows given out; from when it is over; what it gives out then.
Step = Callable[[list | None, int, list], tuple[list | None, list[list]]]
Horizon = Callable[[list], int]
Ending = Callable[[list], list[list]]


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old)


class _InOrder(StatefulProcessor):
    """Rows wait in a list; a timer at the first one's time releases all that the watermark has
    passed and is set anew, one at the horizon ends the state."""

    def __init__(self, step: Step, horizon: Horizon, ending: Ending, names: list[str], key: str) -> None:
        self.step, self.horizon, self.ending, self.names, self.key = step, horizon, ending, names, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row string")
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if pdf.empty:
                continue
            found = list(zip(pdf["row_ms"].tolist(), pdf["row_values"].tolist()))
            self.waiting.appendList([(int(at), row) for at, row in found])
            self.handle.registerTimer(int(min(at for at, _ in found)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []  # all rows up to it are there
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [w for w in waiting if w[0] <= now], [w for w in waiting if w[0] > now]
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        for at, row in ready:
            if state is not None and self.horizon(state) <= at:
                out += self.ending(state)
                state = None
            state, more = self.step(state, at, json.loads(row))
            out += more
        if state is not None and self.horizon(state) <= now:
            out += self.ending(state)
            state = None
        if ready and later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        elif ready:
            self.waiting.clear()
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
            if ready:
                self.handle.registerTimer(int(self.horizon(state)))
        if out:
            yield pd.DataFrame([[key[0], *r] for r in out], columns=[self.key, *self.names])

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, ts: str, values: list[str], step: Step, horizon: Horizon, ending: Ending, schema: str, late: str = "10 minutes") -> DataFrame:
    """``key`` and the columns of ``schema`` (text, long, double or boolean) that ``step`` and ``ending``
    give out.  ``step(state, milliseconds, values)`` folds a row; a state is a list that JSON can hold."""
    kind = stream.schema[key].dataType.simpleString()
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    rows = stream.withWatermark(ts, late).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(key, ts, at.alias("row_ms"), F.to_json(F.array(*[F.col(v).cast("string") for v in values])).alias("row_values"))
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.groupBy(key).transformWithStateInPandas(_InOrder(step, horizon, ending, names, key), f"`{key}` {kind}, {schema}", "Append", "EventTime")


def heartbeats(stream: DataFrame, key: str, ts: str, gap_ms: int, late: str = "10 minutes") -> DataFrame:
    """``key, first, last, beats``: connections that a silence of ``gap_ms`` has ended."""

    def step(state, at, _):
        return ([state[0], at, state[2] + 1] if state else [at, at, 1]), []

    return in_order(stream, key, ts, [ts], step, lambda s: s[1] + gap_ms, lambda s: [s], "first long, last long, beats long", late)


def cooldown(stream: DataFrame, key: str, ts: str, gap_ms: int, late: str = "10 minutes") -> DataFrame:
    """``key, at``: events at least ``gap_ms`` after the last accepted one of their key; a key is
    forgotten when its cooldown is over."""

    def step(state, at, _):
        return (state, []) if state else ([at], [[at]])

    return in_order(stream, key, ts, [ts], step, lambda s: s[0] + gap_ms, lambda s: [], "at long", late)


def durations(stream: DataFrame, key: str, ts: str, state: str, most_ms: int, late: str = "10 minutes") -> DataFrame:
    """``key, state, since, spent, timed_out``: how long each state of a run lasted; one that lasts
    ``most_ms`` is ended by a timer, and the run with it."""

    def step(held, at, values):
        return [values[0], at], ([[held[0], held[1], at - held[1], False]] if held else [])

    return in_order(stream, key, ts, [state], step, lambda s: s[1] + most_ms, lambda s: [[s[0], s[1], most_ms, True]], "state string, since long, spent long, timed_out boolean", late)
