"""Conversations, tasks, decisions and insights.

Sides are aggregated before they are joined, so no sum is multiplied by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import stored

#: Order of severities (fixed values), confidence of each, and the default of a category.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
CONFIDENCE = {"CRITICAL": 0.9, "HIGH": 0.9, "MEDIUM": 0.7, "LOW": 0.5}


def task_summary(tasks: DataFrame, links: DataFrame, turns: DataFrame) -> DataFrame:
    """Each task's distinct sessions, messages and last activity; tasks without sessions stay."""
    per_session = turns.groupBy("session_id").agg(F.count("*").alias("messages"), F.max("ts").alias("ts"))
    per_task = links.select("task_id", "session_id").distinct().join(per_session, "session_id", "left").groupBy("task_id").agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.max("ts").alias("last_activity")
    )
    return tasks.join(per_task, "task_id", "left").fillna(0, ["sessions", "messages"])


def task_activity(tasks: DataFrame, links: DataFrame, sessions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sessions, tokens, decisions, first and last activity of each task; ``sessions`` has
    ``session_id, tokens, ts`` and ``decisions`` ``task_id``."""
    work = links.select("task_id", "session_id").distinct().join(sessions, "session_id").groupBy("task_id").agg(
        F.count_distinct("session_id").alias("sessions"), F.sum("tokens").alias("tokens"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    made = decisions.groupBy("task_id").agg(F.count("*").alias("decisions"))
    return tasks.join(work, "task_id", "left").join(made, "task_id", "left").fillna(0, ["sessions", "tokens", "decisions"])


def timeline(parts: dict[str, DataFrame], k: int) -> DataFrame:
    """Rows ``ts, id`` of all parts in order of time, the first ``k``, with their ``kind``."""
    rows = None
    for kind, part in parts.items():
        one = part.select("ts", F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.orderBy("ts", "kind", "id").limit(k)


def activity_counts(rows: DataFrame, ts: str, as_of) -> DataFrame:
    """One row: all rows, those of the day, those of the last seven days."""
    day, now = F.to_date(F.col(ts).cast("timestamp")), F.to_date(F.lit(as_of).cast("timestamp"))
    return rows.agg(F.count("*").alias("total"), F.count_if(day == now).alias("today"), F.count_if((day <= now) & (day > F.date_sub(now, 7))).alias("week"))


def rolling_summary(turns: DataFrame, by: str, order: str, part: Column, tokens: Column, keep: int = 4) -> DataFrame:
    """For each turn the summary parts of the last ``keep`` turns and its own, joined, and the
    tokens so far."""
    w = Window.partitionBy(by).orderBy(order)
    parts = F.array_join(F.collect_list(part).over(w.rowsBetween(-keep, 0)), " | ")
    return turns.select(by, order, parts.alias("summary"), F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total_tokens"))


def last_messages(turns: DataFrame, by: str, order: str, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return turns.withColumn("__nth", nth).where(F.col("__nth") <= k).drop("__nth")


def related_sessions(sessions: DataFrame, ids: str = "related") -> DataFrame:
    """Each session with the rows of the sessions it names."""
    asked = sessions.select(F.col("session_id").alias("from_session"), F.explode(F.array_distinct(ids)).alias("session_id"))
    return asked.join(sessions.drop(ids), "session_id")


def chain(sessions: DataFrame, user: str, order: str, most: int = 5) -> DataFrame:
    """For each session the latest ``most`` sessions before it of the same user, newest first."""
    w = Window.partitionBy(user).orderBy(order).rowsBetween(-most, -1)
    return sessions.withColumn("related", F.reverse(F.collect_list("session_id").over(w)))


def linked_chain(sessions: DataFrame, key: str = "session_id", stored_list: str = "related", most: int = 5) -> DataFrame:
    """``key``, ``chain``: the first ``most`` other sessions met on the way from each session through
    the stored lists: its own list in order, then that of the last session listed, and so on.

    Pointers jump: in each round a session's way is followed by the way of its last session, so
    ways double; one of ``most`` + 1 hops has met enough ids or goes in a circle.  A way ends at a session without a list, at
    one that is not there and where it comes back to itself; ids that are met again are left out.
    Each round is one join by key; what a session carries is at most ``most`` ids.
    """
    own = F.array_compact(F.coalesce(F.col(stored_list), F.array().cast(sessions.schema[stored_list].dataType)))
    ways = sessions.groupBy(F.col(key).alias("id")).agg(F.min(own).alias("list"))

    def cut(way: Column) -> Column:
        return F.slice(F.array_remove(F.array_distinct(way), F.col("id")), 1, most)

    # The pointer is the raw last id: where it leads is needed even if that is the session itself.
    ways = ways.select("id", cut(F.col("list")).alias("chain"), F.try_element_at("list", F.lit(-1)).alias("next"))
    for _ in range(most.bit_length() + 1):
        ways = stored(ways, "ways")
        to = ways.select(F.col("id").alias("next"), F.col("chain").alias("more"), F.col("next").alias("then"))
        met = ways.join(to, "next", "left")
        full = F.size("chain") >= most
        ways = met.select("id", F.when(full, F.col("chain")).otherwise(cut(F.concat("chain", F.coalesce("more", F.slice("chain", 1, 0))))).alias("chain"), F.when(full, None).otherwise(F.col("then")).alias("next"))
    return ways.select(F.col("id").alias(key), "chain")


def severity_rank(severity: Column) -> Column:
    s = F.upper(severity)
    out = None
    for i, name in enumerate(SEVERITIES):
        out = F.when(s == name, i) if out is None else out.when(s == name, i)
    return out.otherwise(len(SEVERITIES))


def confidence(severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return F.coalesce(table[F.upper(severity)], F.lit(0.5))


def deduplicated(findings: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Of findings whose columns give the same canonical JSON, the first."""
    key = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    first = findings.withColumn("__key", key).groupBy("__key").agg(F.min(F.struct(order, *[c for c in findings.columns if c != order])).alias("row"), F.count("*").alias("copies"))
    return first.select("row.*", "copies")


def top_findings(findings: DataFrame, by: str, severity: str, order: str, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(by).orderBy(severity_rank(F.col(severity)), order))
    return findings.withColumn("rank", nth).where(F.col("rank") <= k)


def older_than(rows: DataFrame, ts: str, as_of, days: int = 90) -> Column:
    """Whether a row is so old that it is to be deleted."""
    return F.col(ts).cast("timestamp") < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))


def turn_labels(turns: DataFrame, text: str = "text") -> DataFrame:
    """Language, intent, query and task type, and whether each message is about code."""
    t = F.col(text)
    return turns.select("*", T.query_language(t).alias("language"), T.query_intent(t).alias("intent"), T.query_type(t).alias("query_type"), T.task_type(t).alias("task_type"), T.about_code(t).alias("about_code"))
