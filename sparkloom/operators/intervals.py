"""Unions of intervals and their join with numbered rows, without one task for a large key.

Running maxima are taken in blocks of positions and carried over blocks, so a window never
holds more of a key than a block, or one row for each of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Positions of a block of intervals, and of a bin in which rows meet intervals.
BLOCK, BIN = 4096, 64


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, include: bool) -> DataFrame:
    """``rows`` (with ``__block``) and the largest ``value`` of the keys' rows before each, or up to it."""
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "__block").agg(F.max(value).alias("__most")).withColumn("__carried", F.max("__most").over(over)).drop("__most")
    both = rows.withColumn("__local", F.max(value).over(inside)).join(carried, [*keys, "__block"])
    return both.withColumn(name, F.greatest("__local", "__carried")).drop("__local", "__carried")


def merged(rows: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``key, start, end, parts``: unions of each key's intervals (``end`` is the first place behind)
    that overlap or touch.  Rows without a key or a bound, and empty ones, are left out."""
    one = rows.select(key, F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end")).where((F.col("start") < F.col("end")) & F.col(key).isNotNull())
    one = one.groupBy(key, "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("parts"))
    one = one.withColumn("__block", F.floor(F.col("start") / BLOCK))
    one = running(one, [key], ["start"], F.col("end"), "__reach", False)
    opens = F.col("__reach").isNull() | (F.col("start") > F.col("__reach"))
    one = running(one.withColumn("__open", F.when(opens, F.col("start"))), [key], ["start"], F.col("__open"), "__first", True)
    return one.groupBy(key, F.col("__first").alias("start")).agg(F.max("end").alias("end"), F.sum("parts").alias("parts"))


def inside(rows: DataFrame, intervals: DataFrame, key: str, place: str) -> DataFrame:
    """``rows`` that lie in an interval of their key, with its ``start`` and ``end``: an equi join by
    key and bin."""
    cut = F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN)))
    side = intervals.select(key, "start", "end", cut.alias("__bin"))
    met = rows.withColumn("__bin", F.floor(F.col(place) / BIN)).join(side, [key, "__bin"])
    return met.where((F.col(place) >= F.col("start")) & (F.col(place) < F.col("end"))).drop("__bin")


def line_context(docs: DataFrame, targets: DataFrame, key: str = "id", text: str = "text", line: str = "line", around: int = 2) -> DataFrame:
    """``key, spans, lines, context``: the lines of each document that lie within ``around`` lines
    of a target (``key``, ``line`` from 0), spans that meet as one, ``# ...`` where lines are left out.

    Targets outside the text and documents without any give no row; null text has no lines.
    """
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "content"))
    sizes = docs.where(F.col(text).isNotNull()).select(key, F.size(F.split(text, "\n")).alias("n"))
    good = targets.select(key, F.col(line).alias("t")).distinct().join(sizes, key).where((F.col("t") >= 0) & (F.col("t") < F.col("n")))
    spans = merged(good.select(key, F.greatest(F.col("t") - around, F.lit(0)).alias("start"), F.least(F.col("t") + around + 1, F.col("n")).alias("end")), key)
    kept = inside(lines, spans, key, "line_no").join(sizes, key)
    before = F.when(F.col("line_no") == F.col("start"), F.when(F.col("start") > 0, F.array(F.lit("# ..."))))
    behind = F.when((F.col("line_no") == F.col("end") - 1) & (F.col("line_no") == F.col("last")), F.when(F.col("end") < F.col("n"), F.array(F.lit("# ..."))))
    last = spans.groupBy(key).agg(F.max("end").alias("e"), F.count(F.lit(1)).alias("spans")).select(key, (F.col("e") - 1).alias("last"), "spans")
    none = F.array().cast("array<string>")
    shown = kept.join(last, key).select(key, "spans", "line_no", F.concat(F.coalesce(before, none), F.array("content"), F.coalesce(behind, none)).alias("shown"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "shown"))), lambda x: x["shown"]))
    return shown.groupBy(key, "spans").agg(F.count(F.lit(1)).alias("lines"), F.array_join(whole, "\n").alias("context"))
