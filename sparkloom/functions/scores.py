"""Scores: normalisation, decay, bands and fixed priorities."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

#: Priorities of chunk types in ranking (fixed values); unknown types have 0.
PRIORITY = {
    "unknown": 0, "comment": 1, "docstring": 2, "constants": 3, "imports": 4, "types": 5, "property": 6, "tests": 7, "readme": 8, "module": 9,
    "namespace": 10, "interface": 11, "constructor": 12, "method": 13, "function": 14, "class": 15, "summary": 16, "super_summary": 17,
}


def min_max(score: Column, *group: str) -> Column:
    """Score scaled to 0..1 within its group; where all are equal, 1."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def age_in_days(ts: Column, as_of: Column) -> Column:
    """Whole days since ``ts``, rounded down."""
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    return F.floor(seconds / 86400)


def recency(score: Column, ts: Column, as_of: Column, decay: float = 0.95) -> Column:
    """Score times ``decay`` to the age in days; without a date, the score."""
    return F.when(ts.isNull(), score).otherwise(score * F.pow(F.lit(decay), age_in_days(ts, as_of)))


def band(score: Column, width: float = 0.1) -> Column:
    return F.floor(score / F.lit(width))


def priority(chunk_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.coalesce(table[F.lower(chunk_type)], F.lit(0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
