"""Findings to insights, and when an analysis is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import about_code

#: Categories and stored types by a part of a finding's type (fixed values).
CATEGORIES = (("bug", "bugs"), ("security", "security"), ("performance", "performance"), ("architect", "architecture"), ("pattern", "patterns"))
KINDS = (("bug", "BUG_RISK"), ("pattern", "PATTERN"), ("connect", "CONNECTION"), ("optim", "OPTIMIZATION"), ("architect", "ARCHITECTURE"))
#: Reasons for fatigue with the weight of a part that calls for each (fixed values).
REASONS = (
    ("instability", 3, 1.5, "unstable files with frequent changes"), ("activity", 3, 2.0, "high recent code activity"), ("volatility", 2, 1.0, "high code volatility"),
    ("architecture", 1, 0.5, "architectural changes detected"), ("time", 1, 0.5, "time since last optimization"),
)


def _first(text: Column, table, default: str) -> Column:
    t, out = F.lower(text), None
    for part, name in table:
        out = F.when(t.contains(part), name) if out is None else out.when(t.contains(part), name)
    return out.otherwise(default)


def category(kind: Column) -> Column:
    return _first(F.coalesce(kind, F.lit("")), CATEGORIES, "other")


def stored_kind(kind: Column) -> Column:
    return _first(F.coalesce(kind, F.lit("")), KINDS, "PATTERN")


def impact(severity: Column, given: Column | None = None) -> Column:
    s = F.upper(severity)
    derived = F.when(s.isin("CRITICAL", "HIGH"), "HIGH").when(s == "MEDIUM", "MEDIUM").otherwise("LOW")
    return derived if given is None else F.when(F.upper(given).isin("HIGH", "MEDIUM", "LOW"), F.upper(given)).otherwise(derived)


def reference(file: Column, line: Column) -> Column:
    return F.when(file.isNotNull(), F.concat_ws(":", file, line.cast("string")))


def consolidated(findings: DataFrame, most_architecture: int = 3) -> DataFrame:
    """Findings that the next cycle starts from: all bugs and security ones of severity CRITICAL,
    and the first few of architecture, by severity and id."""
    c = findings.withColumn("category", category(F.col("type")))
    nth = F.row_number().over(Window.partitionBy("category").orderBy(F.when(F.upper("severity") == "CRITICAL", 0).when(F.upper("severity") == "HIGH", 1).otherwise(2), "id"))
    keep = (F.col("category").isin("bugs", "security") & (F.upper("severity") == "CRITICAL")) | ((F.col("category") == "architecture") & (nth <= most_architecture))
    return c.withColumn("keep", keep).where("keep").drop("keep")


def report(findings: DataFrame, title: str, order: str, most: int = 100) -> DataFrame:
    """``category, markdown``: a section of each category with its worst findings, so many."""
    rank = F.when(F.upper("severity") == "CRITICAL", 0).when(F.upper("severity") == "HIGH", 1).when(F.upper("severity") == "MEDIUM", 2).otherwise(3)
    line = F.concat(F.lit("- **"), F.upper("severity"), F.lit("** "), F.col("description"))
    placed = findings.withColumn("category", category(F.col("type")))
    nth = F.row_number().over(Window.partitionBy("category").orderBy(rank, order))
    rows = placed.withColumn("__nth", nth).where(F.col("__nth") <= most).groupBy("category").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col(order).alias("o"), line.alias("l")))).alias("x"))
    return rows.select("category", F.concat(F.lit(f"## {title}: "), F.col("category"), F.lit("\n"), F.array_join(F.transform("x", lambda y: y["l"]), "\n")).alias("markdown"))


def explanation(fatigue: DataFrame) -> DataFrame:
    """Why fatigue is what it is, from its parts."""
    reasons = F.array_compact(F.array(*[F.when(F.col(part) * weight > bar, F.lit(text)) for part, weight, bar, text in REASONS]))
    text = F.when(F.size(reasons) == 0, "Stable system with normal activity").otherwise(F.concat(F.lit("Fatigue level "), F.format_number("fatigue", 1), F.lit(" due to: "), F.array_join(reasons, ", ")))
    return fatigue.withColumn("explanation", text)


def triggers(files: DataFrame) -> DataFrame:
    """``trigger, n, files``: files with over three conflicts, and fast and unstable ones; the
    first three of each."""
    kinds = F.array_compact(F.array(F.when(F.col("conflicts") > 3, F.lit("high_conflicts")), F.when((F.col("last_30") > 20) & (F.col("stability") < 0.3), F.lit("rapid_changes"))))
    rows = files.select(F.explode(kinds).alias("trigger"), F.col("path").cast("string").alias("path"))
    nth = F.row_number().over(Window.partitionBy("trigger").orderBy("path"))
    return rows.withColumn("nth", nth).groupBy("trigger").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.col("path")))), ",").alias("files"))


def model_fatigue(time: Column, fragmentation: Column, degradation: Column, new_ratio: Column) -> Column:
    """The four-part measure (0 to 10); optimisation is due above 7."""
    return time * 0.2 + fragmentation * 0.3 + degradation * 0.3 + new_ratio * 0.2


def recommendation(level: Column) -> Column:
    return (
        F.when(level < 3, "System optimized, no action required").when(level < 5, "Good performance, optimization not urgent")
        .when(level < 7, "Consider optimization soon for better performance").when(level < 9, "Optimization recommended - notable degradation")
        .otherwise("Urgent optimization - significantly degraded performance")
    )


def reduced(level: Column, factor: float = 0.3) -> Column:
    """Fatigue after an analysis; the factor is applied once."""
    return level * factor


def suggests(level: Column, message: Column, last_run: Column, running: Column, as_of: Column) -> Column:
    """Whether to suggest an analysis: never while one runs; above 9.5 always; above 7.5 for
    queries about code if the last run is two hours back."""
    hours = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(last_run.cast("timestamp"))) / 3600
    due = (level > 7.5) & about_code(message) & (last_run.isNull() | (hours >= 2))
    return ~running & ((level > 9.5) | due)
