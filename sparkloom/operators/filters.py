"""Filters on chunk columns, and a dictionary of filters as one predicate."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def has_extension(path: Column, extensions: list[str]) -> Column:
    """Path ends with one of the extensions, with or without their dot; none: all pass."""
    if not extensions:
        return F.lit(True)
    found = F.lit(False)
    for e in extensions:
        found |= path.endswith(e if e.startswith(".") else f".{e}")
    return found


def in_dates(raw: Column, start=None, end=None) -> Column:
    """Date text within both ends (inclusive); null passes, what is no date does not."""
    ts = F.try_to_timestamp(raw.cast("string"))
    ok = ts.isNotNull()
    if start is not None:
        ok &= ts >= F.lit(start).cast("timestamp")
    if end is not None:
        ok &= ts <= F.lit(end).cast("timestamp")
    return raw.isNull() | ok


def path_matches(path: Column, pattern: str) -> Column:
    """Case-insensitive regular expression anywhere in the path; an invalid one passes all."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(True)
    return path.rlike(f"(?i){pattern}")


def in_languages(language: Column, languages: list[str]) -> Column:
    return F.lower(language).isin([x.lower() for x in languages]) if languages else F.lit(True)


def of_types(chunk_type: Column, types: list[str]) -> Column:
    return F.lower(chunk_type).isin([x.lower() for x in types]) if types else F.lit(True)


def predicate(spec: dict, columns: dict[str, str] | None = None) -> Column:
    """All filters of ``spec`` together: extensions, languages, date_from and date_to, path,
    chunk_types.  ``columns`` names the columns they apply to."""
    c = {"path": "file_path", "language": "language", "date": "last_modified", "type": "chunk_type"} | (columns or {})
    ok = F.lit(True)
    if spec.get("extensions"):
        ok &= has_extension(F.col(c["path"]), spec["extensions"])
    if spec.get("languages"):
        ok &= in_languages(F.col(c["language"]), spec["languages"])
    if spec.get("date_from") or spec.get("date_to"):
        ok &= in_dates(F.col(c["date"]), spec.get("date_from"), spec.get("date_to"))
    if spec.get("path"):
        ok &= path_matches(F.col(c["path"]), spec["path"])
    if spec.get("chunk_types"):
        ok &= of_types(F.col(c["type"]), spec["chunk_types"])
    return ok


def safe_path(path: Column) -> Column:
    """Not empty, relative, and without a step up."""
    return (F.length(F.trim(path)) > 0) & ~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:") & ~F.array_contains(F.split(path, r"[/\\]"), "..")


def mentions(columns: list[Column], keywords: list[str]) -> Column:
    """Any column contains any keyword, ASCII case aside; none: nothing passes."""
    found = F.lit(False)
    for c in columns:
        for k in keywords:
            found |= F.lower(c).contains(k.lower())
    return found
