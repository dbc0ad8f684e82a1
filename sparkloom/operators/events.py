"""Events: replay, cooldown, fan-out, change feeds, progress and states, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .folding import folded

#: Allowed changes of state of an analysis cycle (fixed values).
STATES = {
    "MONITORING": ("DROWSY",), "DROWSY": ("DREAMING", "MONITORING"), "DREAMING": ("REM", "MONITORING"), "REM": ("DEEP_SLEEP", "MONITORING"),
    "DEEP_SLEEP": ("WAKING", "MONITORING"), "WAKING": ("MONITORING",),
}


#: Part of an analysis cycle that each state takes (fixed values).
PARTS = {"DROWSY": 0.1, "DREAMING": 0.3, "REM": 0.4, "DEEP_SLEEP": 0.1, "WAKING": 0.1}


def state_times(rows: DataFrame, run: str, order: str, state: str, seconds: str, cycle_minutes: float = 5.0) -> DataFrame:
    """Time spent in each state until the next change, and the time that the cycle allows for it
    (none for states outside the cycle)."""
    spent = F.lead(seconds).over(Window.partitionBy(run).orderBy(order)) - F.col(seconds)
    share = F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv])[F.col(state)]
    return rows.withColumn("spent", spent).withColumn("allowed", share * (cycle_minutes * 60)).withColumn("over", F.col("spent") > F.col("allowed"))


def replay(events: DataFrame, ts: str, kind: str, start, end, kinds: list[str]) -> DataFrame:
    """Events of the kinds within both times, inclusive."""
    t = F.col(ts).cast("timestamp")
    ok = (t >= F.lit(start).cast("timestamp")) & (t <= F.lit(end).cast("timestamp"))
    return events.where(ok & F.col(kind).isin(kinds))


def cooldown(events: DataFrame, keys: list[str], seconds: str, order: str, gap: float) -> DataFrame:
    """Events that come at least ``gap`` seconds after the last accepted one of their key.

    Which event is accepted depends on the one accepted before, so each key's events are
    read in order; state is one number a key, so a key may have any number of events: they
    stream through sorted partitions and are never gathered.
    """

    def start():
        last = None

        def step(t):
            nonlocal last
            if last is not None and t - last < gap:
                return None
            last = t
            return True

        return step

    return folded(events, keys, [seconds, order], seconds, start, "__ok", "boolean").drop("__ok")


def apply_feed(state: DataFrame, feed: DataFrame, key: str, action: str, order: str) -> DataFrame:
    """``state`` after a change feed: the latest action of a key counts; added and modified
    replace, deleted removes."""
    rest = [c for c in feed.columns if c != key]
    last = feed.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("row")).select(key, "row.*")
    kept = state.join(feed.select(key).distinct(), key, "left_anti")
    return kept.unionByName(last.where(F.col(action) != "deleted").select(*state.columns))


def renamed(chunks: DataFrame, pairs: DataFrame, path: str = "file_path") -> DataFrame:
    """Chunks under their new paths; ``pairs`` has ``old_path, new_path``."""
    return chunks.join(pairs, F.col(path) == F.col("old_path"), "left").withColumn(path, F.coalesce("new_path", path)).drop("old_path", "new_path")


def invalidations(files: DataFrame, services: list[str], most: int = 10) -> DataFrame:
    """A message for each of an event's first files and each service."""
    rows = files.select("event_id", F.explode(F.slice("files", 1, most)).alias("file"))
    return rows.select("event_id", "file", F.explode(F.array(*[F.lit(s) for s in services])).alias("service"), F.concat(F.lit("*"), F.col("file"), F.lit("*")).alias("pattern"))


def matching(files: DataFrame, pattern: str, k: int = 50, path: str = "path") -> DataFrame:
    """Files of a pattern: those that end with it, else those that hold it; the first ``k``."""
    core = pattern.strip("*")
    rank = F.when(F.col(path).endswith(core), 0).otherwise(1)
    return files.where(F.col(path).contains(core)).orderBy(rank, path).limit(k)


def valid_change(action: Column, trigger: Column) -> Column:
    return action.isin("added", "modified", "deleted", "renamed") & trigger.isin("commit", "pull", "checkout", "fetch", "manual", "cache_invalidation")


def valid_lists(changes: DataFrame, by: str, action: str, trigger: str, most: int = 1000) -> DataFrame:
    """``by, files, valid`` of lists of changes: all known actions and triggers, not too many."""
    ok = F.bool_and(valid_change(F.col(action), F.col(trigger)))
    return changes.groupBy(by).agg(F.count("*").alias("files"), ok.alias("valid")).withColumn("valid", F.col("valid") & (F.col("files") <= most))


def transitions(rows: DataFrame, run: str, order: str, state: str) -> DataFrame:
    """Each change of state and whether it is allowed."""
    before = F.lag(state).over(Window.partitionBy(run).orderBy(order))
    ok = F.lit(False)
    for a, bs in STATES.items():
        ok |= (F.col("before") == a) & F.col(state).isin(list(bs))
    return rows.withColumn("before", before).withColumn("allowed", F.col("before").isNull() | ok)


def progress(events: DataFrame, task: str, current: str, total: str, seconds: str) -> DataFrame:
    """Latest state of each task: percent, rate, time left, and whether it is done."""
    last = events.groupBy(task).agg(F.max(F.struct(seconds, current, total)).alias("x"), F.min(seconds).alias("t0"))
    c, n, t = F.col("x")[current], F.col("x")[total], F.col("x")[seconds] - F.col("t0")
    pace = F.when(t > 0, c / t).otherwise(0.0)
    return last.select(task, c.alias("current"), n.alias("total"), F.try_divide(c * F.lit(100.0), n).alias("percent"), pace.alias("per_second"), F.when(pace > 0, (n - c) / pace).alias("seconds_left"), (c >= n).alias("done"))
