"""File metrics from commit history.

``changes`` has ``path, sha, author, ts, message, insertions, deletions`` (a row for each
file of a commit).  Every operator takes ``as_of`` instead of the present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import age_in_days, clamp

#: Words of a message that tell of a conflict, and prefixes that tell a commit's type (fixed values).
CONFLICT = r"merge conflict|resolve conflict|fix conflict|conflict resolution|<<<<<<|>>>>>>|conflicts resolved"
TYPES = ("feat", "fix", "docs", "style", "refactor", "test", "chore")


def _recent(ts: str, as_of, days: int) -> Column:
    return age_in_days(F.col(ts), F.lit(as_of)).between(0, days)


def commit_stats(changes: DataFrame, as_of) -> DataFrame:
    """Commits of each file: all, in 30 days (at most 50), a week (over a year), first, last,
    and the pattern of activity."""
    one = changes.groupBy("path", "sha").agg(F.min("ts").alias("ts"), F.min("author").alias("author"))
    n = one.groupBy("path").agg(
        F.greatest(F.lit(1), F.count("*")).alias("total"), F.least(F.lit(50), F.count_if(_recent("ts", as_of, 30))).alias("last_30"),
        F.round(F.count_if(_recent("ts", as_of, 365)) / 52, 2).alias("weekly"),
        F.min_by("author", F.struct("ts", "sha")).alias("created_by"), F.max_by("author", F.struct("ts", "sha")).alias("last_author"), F.min("ts").alias("created_at"), F.max("ts").alias("changed_at"),
    )
    pattern = F.when(F.col("last_30") == 0, "inactive").when(F.col("last_30") > 2 * (F.col("total") * 0.1), "burst").when(F.col("weekly") >= 1, "steady").otherwise("sporadic")
    return n.withColumn("pattern", pattern)


def contributors(blame: DataFrame, path: str, author: str, ts: str) -> DataFrame:
    """Lines of each author in a file, their share in percent, first and last date."""
    n = blame.groupBy(path, author).agg(F.count("*").alias("lines"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return n.withColumn("share", F.round(F.col("lines") * 100 / F.sum("lines").over(Window.partitionBy(path)), 1))


def volatility(changes: DataFrame, sizes: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Changed lines of the last days against current lines, at most 1; an empty file has 1,
    one without changes 0.1; with conflicts, stability.  ``sizes`` has ``path, lines``."""
    n = changes.groupBy("path").agg(
        F.sum(F.when(_recent("ts", as_of, days), F.col("insertions") + F.col("deletions"))).alias("changed"),
        F.count_distinct(F.when(F.lower("message").rlike(CONFLICT), F.col("sha"))).alias("conflicts"),
    )
    rows = sizes.join(n, "path", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    v = F.when(F.col("changed").isNull(), 0.1).when(F.col("lines") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("changed") / F.col("lines")))
    rows = rows.withColumn("volatility", v)
    return rows.withColumn("stability", clamp(1 - F.least(F.lit(0.6), 0.1 * F.col("conflicts")) - 0.4 * F.col("volatility")))


def moves(history: DataFrame, file: str, directory: str, *order: str) -> DataFrame:
    """How often each file's directory differs from the one before, in order of time."""
    before = F.lag(directory).over(Window.partitionBy(file).orderBy(*order))
    return history.withColumn("__before", before).groupBy(file).agg(F.count_if(F.col("__before") != F.col(directory)).alias("moves"))


def commit_type(message: Column) -> Column:
    """Conventional prefix of a message, followed by a colon, bracket or blank; else other."""
    found = F.regexp_extract(F.lower(message), rf"^({'|'.join(TYPES)})[:( ]", 1)
    return F.when(found == "", "other").otherwise(found)


def type_histogram(commits: DataFrame, by: str, latest: int = 100) -> DataFrame:
    """Commits of each type among the latest of each ``by``; ``commits`` has ``sha, ts, message``."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("sha")))
    return commits.withColumn("__nth", nth).where(F.col("__nth") <= latest).groupBy(by, commit_type(F.col("message")).alias("type")).agg(F.count("*").alias("n"))


def last_refactor(commits: DataFrame, by: str, newest: int = 50, word: str = "refactor") -> DataFrame:
    """Date of the latest commit whose message has the word, among the newest of each ``by``."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("sha")))
    hit = F.when(F.lower("message").contains(word), F.col("ts"))
    return commits.withColumn("__nth", nth).where(F.col("__nth") <= newest).groupBy(by).agg(F.max(hit).alias("refactored_at"))


def conflict_risk(changes: DataFrame, staged: DataFrame | None = None, look: int = 3) -> DataFrame:
    """Distinct authors among a file's latest commits: from two on a severity of 5 + 2 n (10
    at most), five more for staged files, and advice by severity."""
    one = changes.groupBy("path", "sha").agg(F.max("ts").alias("ts"), F.max("author").alias("author"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("sha")))
    n = one.withColumn("__nth", nth).where(F.col("__nth") <= look).groupBy("path").agg(F.count_distinct("author").alias("authors"))
    severity = F.when(F.col("authors") >= 2, F.least(F.lit(10), 5 + 2 * F.col("authors"))).otherwise(0)
    if staged is not None:
        n = n.join(staged.select(F.col("path").alias("__p")).distinct(), F.col("path") == F.col("__p"), "left")
        severity += F.when(F.col("__p").isNotNull(), 5).otherwise(0)
    rows = n.select("path", "authors", severity.cast("long").alias("severity"))
    advice = F.when(F.col("severity") >= 10, "coordinate").when(F.col("severity") >= 5, "review").otherwise("none")
    return rows.withColumn("advice", advice)


def by_others(changes: DataFrame, mine: list, as_of, hours: int = 24) -> DataFrame:
    """Commits of the last hours by other authors, with their files in order."""
    ts = F.col("ts").cast("timestamp")
    window = (ts > F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours))) & (ts <= F.lit(as_of).cast("timestamp"))
    rows = changes.where(window & ~F.col("author").isin(mine))
    return rows.groupBy("sha", "author").agg(F.max("ts").alias("ts"), F.array_join(F.array_sort(F.collect_set(F.col("path").cast("string"))), ",").alias("files"))


def recent_files(changes: DataFrame, as_of, days: int, k: int) -> DataFrame:
    """The ``k`` files changed last within the days."""
    last = changes.where(_recent("ts", as_of, days)).groupBy("path").agg(F.max("ts").alias("changed_at"))
    return last.orderBy(F.desc("changed_at"), "path").limit(k)


def activity_score(changes: DataFrame, as_of, k: int = 50) -> DataFrame:
    """Files by recency (0.4, falling to 0 in 30 days), commits (0.3, of 10), changed lines
    (0.2, of 500) and a search score (0.1, where ``changes`` has ``score``)."""
    score = F.coalesce(F.max("score"), F.lit(0.0)) if "score" in changes.columns else F.lit(0.0)
    n = changes.groupBy("path").agg(F.max("ts").alias("ts"), F.count_distinct("sha").alias("commits"), F.sum(F.col("insertions") + F.col("deletions")).alias("lines"), score.alias("hit"))
    age = age_in_days(F.col("ts"), F.lit(as_of))
    total = 0.4 * clamp(1 - age / 30) + 0.3 * F.least(F.lit(1.0), F.col("commits") / 10) + 0.2 * F.least(F.lit(1.0), F.col("lines") / 500) + 0.1 * F.col("hit")
    return n.withColumn("activity", total).orderBy(F.desc(F.round("activity", 9)), "path").limit(k)


def fatigue(files: DataFrame, changes: DataFrame, last_run, as_of, manifests: list[str], restructures: int = 0) -> DataFrame:
    """One row: the five parts of fatigue and their weighted total, at most 10.

    ``files`` has ``path, stability, volatility`` of each file; parts look at files changed
    in 7 days (stability, volatility) and at 30 days of changes (activity, architecture).
    """
    week = changes.where(_recent("ts", as_of, 7)).select("path").distinct()
    near = files.join(week, "path", "left_semi").agg(F.coalesce(F.avg(1 - F.col("stability")), F.lit(0.0)).alias("instability"), F.coalesce(F.avg("volatility"), F.lit(0.0)).alias("volatility"))
    month = changes.where(_recent("ts", as_of, 30))
    per_file = month.groupBy("path").agg(F.count_distinct("sha").alias("k")).agg(F.count("*").alias("files"), F.count_if(F.col("k") > 10).alias("busy"))
    total = month.agg(F.count_distinct("sha").alias("commits"), F.count_distinct(F.when(F.col("path").cast("string").isin(manifests), F.col("path"))).alias("manifests"))
    days = age_in_days(F.lit(last_run).cast("timestamp"), F.lit(as_of)) if last_run else F.lit(30)
    one = near.crossJoin(per_file).crossJoin(total)

    def part(x: Column, of: float) -> Column:
        return F.least(F.lit(1.0), x / of)

    rows = one.select(
        part(days, 30.0).alias("time"), "instability",
        (0.3 * part(F.col("files"), 100.0) + 0.4 * part(F.col("commits"), 200.0) + 0.3 * part(F.col("busy"), 10.0)).alias("activity"), "volatility",
        (0.7 * part(F.col("manifests"), 3.0) + 0.3 * part(F.lit(restructures), 5.0)).alias("architecture"),
    )
    total = F.col("time") + 3 * F.col("instability") + 3 * F.col("activity") + 2 * F.col("volatility") + F.col("architecture")
    level = F.when(F.col("fatigue") > 9.5, "emergency").when(F.col("fatigue") > 7.5, "high").when(F.col("fatigue") > 5, "moderate").when(F.col("fatigue") > 3, "low").otherwise("rested")
    return rows.withColumn("fatigue", F.least(F.lit(10.0), total)).withColumn("level", level)


def fatigue_history(spark, days: int, now: float, last_run_days_ago: int, growth: float = 0.2, after: float = 0.3):
    """``days_ago, fatigue`` for each day: today's value less the growth of each day back; on
    and before the last run the value that the run reduced."""
    rows = spark.range(days + 1).select(F.col("id").alias("days_ago"))
    since = F.col("days_ago") <= last_run_days_ago
    back = F.greatest(F.lit(0.0), F.lit(now) - growth * F.col("days_ago"))
    before = F.least(F.lit(10.0), F.greatest(F.lit(0.0), (F.lit(now) - growth * last_run_days_ago) / after - growth * (F.col("days_ago") - last_run_days_ago)))
    return rows.withColumn("fatigue", F.when(since, back).otherwise(before))


def metrics(changes: DataFrame, sizes: DataFrame, as_of) -> DataFrame:
    """All file metrics side by side: activity, volatility and stability of each file."""
    return volatility(changes, sizes, as_of).join(commit_stats(changes, as_of), "path", "left")
