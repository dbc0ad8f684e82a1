"""Fitting chunks into a token budget.

Greedy packing takes what still fits and skips what does not, which no running sum can say:
rows stream in order past a fold whose state is the tokens used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .folding import folded


def packed(rows: DataFrame, by: str, key: str, tokens: str, score: str, budget: int) -> DataFrame:
    """``by, key, tokens, used`` of the rows kept: in order of score, each that still fits."""

    def start():
        used = 0

        def step(t):
            nonlocal used
            if used + t > budget:
                return None
            used += t
            return used

        return step

    one = rows.select(by, key, F.col(tokens).cast("long").alias("tokens"), (-F.col(score)).alias("__o"))
    return folded(one, [by], ["__o", key], "tokens", start, "used", "long").drop("__o")


def batches(rows: DataFrame, by: str, key: str, tokens: str, limit: int) -> DataFrame:
    """``by, key, batch``: rows in order of key, a new batch whenever the limit would be passed;
    a row over the limit is alone."""

    def start():
        used, batch = 0, -1

        def step(t):
            nonlocal used, batch
            if batch < 0 or used + t > limit:
                used, batch = 0, batch + 1
            used += t
            return batch

        return step

    one = rows.select(by, key, F.col(tokens).cast("long").alias("__t"))
    return folded(one, [by], [key], "__t", start, "batch", "int").drop("__t")


def should_compress(kind: Column, total: Column, mean: Column, budget: int, least: int = 100) -> Column:
    """Only specific queries whose chunks are large enough and over the budget."""
    return (kind == "specific") & (mean >= least) & (total > budget)


def ratio(relevance: Column) -> Column:
    """Part of a chunk to keep, by its relevance."""
    return F.when(relevance > 0.8, 0.9).when(relevance > 0.5, 0.6).otherwise(0.3)


def compressed_code(content: Column, relevance: Column, longest_comment: int = 80) -> Column:
    """Code by relevance: without long comments and repeated blank lines, without comments and
    blank lines, or signatures alone (first lines where there are none)."""
    parts = F.split(content, "\n")
    comment = r"^\s*(#|//|/\*)"
    shorter = F.filter(parts, lambda x: ~(x.rlike(comment) & (F.length(x) > longest_comment)))
    light = F.filter(shorter, lambda x, i: (F.length(F.trim(x)) > 0) | (i == 0) | (F.length(F.trim(F.element_at(shorter, F.when(i == 0, 1).otherwise(i)))) > 0))
    bare = F.filter(parts, lambda x: ~x.rlike(r"^\s*(#|//)") & (F.length(F.trim(x)) > 0))
    named = F.filter(parts, lambda x: x.rlike(r"^\s*(?:export\s+)?(?:async\s+)?(def|class|function|func|fn)\s+\w+"))
    first = F.slice(F.filter(F.slice(parts, 1, 10), lambda x: (F.length(F.trim(x)) > 0) & ~x.rlike(comment)), 1, 3)
    names = F.when(F.size(named) > 0, F.transform(named, lambda x: F.trim(x))).otherwise(F.concat(first, F.array(F.lit("# ..."))))
    return F.array_join(F.when(relevance > 0.8, light).when(relevance > 0.5, bare).otherwise(names), "\n")


def compressed_markdown(content: Column, relevance: Column) -> Column:
    """Text by relevance: whole, headers with the line after each, or headers alone."""
    parts = F.filter(F.split(content, "\n"), lambda x: F.length(F.trim(x)) > 0)
    header = r"^#{1,6}\s"
    after = F.filter(parts, lambda x, i: x.rlike(header) | ((i > 0) & F.element_at(parts, F.when(i == 0, 1).otherwise(i)).rlike(header)))
    return F.array_join(F.when(relevance > 0.8, parts).when(relevance > 0.5, after).otherwise(F.filter(parts, lambda x: x.rlike(header))), "\n")


def compressed_config(content: Column, relevance: Column) -> Column:
    """Settings by relevance: all, keys with values, or section names."""
    parts = F.split(content, "\n")
    pair, section = r"^\s*[\w.\-\"]+\s*[:=]", r"^\s*\[.*\]\s*$|^[\w.-]+:\s*$"
    return F.array_join(F.when(relevance > 0.8, parts).when(relevance > 0.5, F.filter(parts, lambda x: x.rlike(pair))).otherwise(F.filter(parts, lambda x: x.rlike(section))), "\n")


def compressed_data(content: Column, relevance: Column, sample: int = 10) -> Column:
    """Rows by relevance: head and tail, the first row, or the number of rows."""
    parts = F.split(content, "\n")
    ends = F.when(F.size(parts) <= 2 * sample, parts).otherwise(F.concat(F.slice(parts, 1, sample), F.array(F.lit("...")), F.slice(parts, -sample, sample)))
    return F.when(relevance > 0.8, F.array_join(ends, "\n")).when(relevance > 0.5, F.element_at(parts, 1)).otherwise(F.concat(F.lit("# rows: "), F.size(parts).cast("string")))


def compressed_other(content: Column, relevance: Column) -> Column:
    """First 2,000 characters, or 25 lines from either end."""
    parts = F.split(content, "\n")
    ends = F.when(F.size(parts) <= 50, parts).otherwise(F.concat(F.slice(parts, 1, 25), F.array(F.lit("...")), F.slice(parts, -25, 25)))
    return F.when(relevance > 0.8, F.array_join(ends, "\n")).otherwise(F.substring(content, 1, 2000))


def compressed(content: Column, kind: Column, relevance: Column) -> Column:
    """A chunk by the strategy of its document type."""
    return (
        F.when(kind == "code", compressed_code(content, relevance)).when(kind == "markdown", compressed_markdown(content, relevance))
        .when(kind == "config", compressed_config(content, relevance)).when(kind == "data", compressed_data(content, relevance)).otherwise(compressed_other(content, relevance))
    )


def compressed_within(rows: DataFrame, by: str, key: str, budget: int, content: str = "content", kind: str = "kind", relevance: str = "relevance") -> DataFrame:
    """Chunks compressed by relevance and packed into each query's budget."""
    done = rows.withColumn(content, compressed(F.col(content), F.col(kind), F.col(relevance)))
    done = done.withColumn("__tokens", T.token_estimate(F.col(content)))
    kept = packed(done, by, key, "__tokens", relevance, budget)
    return kept.join(done.select(by, key, content, relevance), [by, key])
