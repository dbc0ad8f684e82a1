"""Brackets of texts: structure checks of settings files, and where definitions end in
languages with braces.

A bracket's partner is the bracket before it at its depth, up to the first error of a text;
depths are running sums.  Both are taken in blocks of lines and carried over blocks, so a
long text is sorted and summed in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import parts, shuffled, stored
from .intervals import running

#: Lines of a block; marks that a task sorts, which it does several times.
BLOCK, MARKS = 512, 1 << 17
#: Lines that are not looked at (fixed values), and closing brackets by their opening ones.
COMMENTS = ("#", "//", "/*", "<!--")
PAIRS = {"[": "]", "{": "}", "(": ")"}

_LINE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,8})'"
_QUOTED = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_SLASHES, _BLOCK, _HASH = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\z)", r"#[^\n]*"
#: What is skipped in a language with braces: comments and strings, the longest forms first.
SKIPPED = {
    "javascript": (_SLASHES, _BLOCK, _LINE, _QUOTED, r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"), "typescript": (_SLASHES, _BLOCK, _LINE, _QUOTED, r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"),
    "java": (_SLASHES, _BLOCK, r'"""(?s:.*?)"""', _LINE, _CHAR), "csharp": (_SLASHES, _BLOCK, r'@"(?:[^"]|"")*+"', _LINE, _CHAR), "go": (_SLASHES, _BLOCK, _LINE, _CHAR, r"`[^`]*+`"),
    "rust": (_SLASHES, _BLOCK, r'r#"(?s:.*?)"#', _LINE, _CHAR), "c": (_SLASHES, _BLOCK, _LINE, _CHAR), "cpp": (_SLASHES, _BLOCK, _LINE, _CHAR), "php": (_SLASHES, _BLOCK, _HASH, _LINE, _QUOTED),
    "swift": (_SLASHES, _BLOCK, r'"""(?s:.*?)"""', _LINE), "kotlin": (_SLASHES, _BLOCK, r'"""(?s:.*?)"""', _LINE, _CHAR), "css": (_BLOCK, _LINE, _QUOTED),
}


def _opens(char: Column) -> Column:
    return char.isin(list(PAIRS))


def paired(marks: DataFrame, key: str) -> DataFrame:
    """``marks`` (``line_no``, ``at``, ``char``) with ``depth`` (that of the pair, from 1) and
    ``before``: the mark before it at that depth (``line_no``, ``at``, ``char``)."""
    step = F.when(_opens(F.col("char")), 1).otherwise(-1)
    rows = marks.withColumn("__block", F.floor(F.col("line_no") / BLOCK)).withColumn("__step", step)
    inside = Window.partitionBy(key, "__block").orderBy("line_no", "at").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(key, "__block").agg(F.sum("__step").alias("__sum")).withColumn("__carried", F.coalesce(F.sum("__sum").over(over), F.lit(0))).drop("__sum")
    depth = F.sum("__step").over(inside)
    rows = rows.withColumn("__local", depth).join(carried, [key, "__block"])
    rows = rows.withColumn("depth", F.col("__local") + F.col("__carried") + F.when(F.col("__step") < 0, 1).otherwise(0)).drop("__local", "__carried", "__step")
    return running(rows, [key, "depth"], ["line_no", "at"], F.struct("line_no", "at", "char"), "before", False).drop("__block")


def checked(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, valid, line, message``: whether a text's brackets match, and the first error (line from
    1): a closing bracket that meets nothing or another kind, else the first one left open.  Lines
    that begin as comments are not looked at; null text is valid.  Marks are written once and dealt
    in proportion to their number; the result is written, too."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("__i", "line"))
    comment = F.lit(False)
    for c in COMMENTS:
        comment |= F.ltrim("line").startswith(c)
    found = F.posexplode(F.regexp_extract_all("line", F.lit(r"[\[\](){}]"), F.lit(0)))
    marks = stored(lines.where(~comment).select(key, (F.col("__i") + 1).alias("line_no"), found.alias("at", "char")), "marks")
    rows = paired(marks, key)
    closes = F.create_map(*[F.lit(x) for kv in PAIRS.items() for x in kv])
    wanted = F.try_element_at(closes, F.col("before.char"))
    message = F.when(_opens(F.col("char")), None).when(F.col("depth") < 1, F.concat(F.lit("Unexpected closing "), "char")).when(wanted != F.col("char"), F.concat(F.lit("Mismatched bracket: expected "), wanted, F.lit(", got "), "char"))
    first = F.min(F.when(message.isNotNull(), F.struct("line_no", "at", message.alias("message")))).alias("error")
    lowest = F.max(F.when(F.col("depth") == 1, F.struct("line_no", "at", "char"))).alias("lowest")
    sums = rows.groupBy(key).agg(first, lowest, F.sum(F.when(_opens(F.col("char")), 1).otherwise(-1)).alias("open"))
    left = F.struct(F.col("lowest.line_no").alias("line_no"), F.col("lowest.at").alias("at"), F.concat(F.lit("Unclosed "), F.col("lowest.char")).alias("message"))
    sums = sums.select(key, F.coalesce("error", F.when(F.col("open") > 0, left)).alias("error"))
    out = docs.select(key).join(sums, key, "left")
    with shuffled(docs.sparkSession, parts(marks, MARKS)):
        return stored(out.select(key, F.col("error").isNull().alias("valid"), F.col("error.line_no").alias("line"), F.col("error.message").alias("message")), "checks")


def code_marks(docs: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """``key, line_no, at, char``: braces and semicolons of code, outside strings and comments.

    One pattern reads the text from left to right, so what begins in code decides how far a string
    or comment goes; line ends are counted through all tokens."""
    tokens = None
    for name, skipped in SKIPPED.items():
        cut = F.regexp_extract_all(text, F.lit("|".join([*skipped, r"[{};\n]"])), F.lit(0))
        tokens = F.when(F.col(language) == name, cut) if tokens is None else tokens.when(F.col(language) == name, cut)
    rows = docs.select(key, F.posexplode(tokens).alias("at", "token"))
    breaks = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    line = F.coalesce(F.sum(breaks).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return rows.withColumn("line_no", line).where(F.col("token").isin("{", "}", ";")).select(key, "line_no", "at", F.col("token").alias("char"))


def ended(definitions: DataFrame, docs: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """``definitions`` (``key``, ``start_line``, ``end_line``) of languages with braces with the line
    on which their body closes, and others as they are.

    The body opens at the first brace that comes before the next definition begins and before any
    semicolon or closing brace; of several on its line, at one that closes on a later line.  A
    definition without a body ends where it begins, one that never closes with the text.  Marks and
    result are written as in ``checked``."""
    code = docs.where(F.col(language).isin(list(SKIPPED)))
    marks = stored(code_marks(code, key, text, language), "marks")
    pairs = paired(marks.where("char <> ';'"), key)
    closed = pairs.where((F.col("char") == "}") & (F.col("depth") > 0)).select(key, F.col("before.at").alias("at"), F.col("line_no").alias("close"))
    size = code.select(key, F.size(F.split(text, "\n")).alias("n"))
    braces = marks.where("char = '{'").join(closed, [key, "at"], "left").join(size, key).select(key, F.col("line_no").alias("body"), "at", F.coalesce("close", "n").alias("close"))
    body = braces.groupBy(key, "body").agg(F.coalesce(F.min(F.when(F.col("close") > F.col("body"), F.struct("at", "close"))), F.min(F.struct("at", "close")))["close"].alias("close"))
    inner = definitions.where(F.col(language).isin(list(SKIPPED)))
    starts = inner.select(key, F.col("start_line").cast("long").alias("line_no"), F.lit(-1).alias("at"), F.lit("def").alias("char"))
    after = Window.partitionBy(key).orderBy("line_no", "at")
    following = starts.unionByName(marks.select(key, F.col("line_no").cast("long").alias("line_no"), "at", "char"))
    following = following.withColumn("next", F.lead(F.struct("line_no", "char")).over(after)).where("char = 'def'")
    opening = following.select(key, F.col("line_no").alias("start_line"), F.when(F.col("next.char") == "{", F.col("next.line_no")).alias("body"))
    found = opening.join(body, [key, "body"], "left").select(key, "start_line", F.coalesce("close", "start_line").alias("__end"))
    found = found.groupBy(key, "start_line").agg(F.max("__end").alias("__end"))
    out = definitions.join(found, [key, "start_line"], "left")
    kind = definitions.schema["end_line"].dataType
    with shuffled(docs.sparkSession, parts(marks, MARKS)):
        return stored(out.withColumn("end_line", F.coalesce("__end", "end_line").cast(kind)).select(*definitions.columns), "ends")
