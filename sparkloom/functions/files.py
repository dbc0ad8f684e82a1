"""What a path or a text says about its kind: language, category, chunk type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Languages by extension, special names, categories by language.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "lua": "lua", "pl": "perl", "r": "r", "sh": "bash", "bash": "bash", "vim": "vim", "el": "elisp", "sql": "sql",
    "html": "html", "htm": "html", "css": "css", "scss": "css", "md": "markdown", "rst": "markdown", "txt": "text", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini", "conf": "ini",
    "xml": "xml", "csv": "csv", "mk": "makefile",
}
NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "readme": "markdown", ".gitignore": "text", ".env": "ini"}
DOCUMENTATION, CONFIGURATION, DATA = ("markdown", "text", "html"), ("json", "yaml", "toml", "ini", "xml", "dockerfile", "makefile"), ("csv", "sql")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def language(path: Column) -> Column:
    """Language of a path: special names first, then the extension; else unknown."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.coalesce(_map(NAMES)[name], _map(LANGUAGES)[F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)], F.lit("unknown"))


# Signs of languages in a text without a telling name.
SIGNS = {
    "python": r"(?m)^\s*(?:def \w+\(|class \w+.*:|import \w+|from \w+ import )", "javascript": r"(?m)\b(?:const|let|var) \w+ =|function \w*\(|=> \{", "java": r"(?m)\bpublic (?:class|static|void)\b|\bimport java",
    "go": r"(?m)^package \w+|^func ", "rust": r"(?m)\bfn \w+|\blet mut ", "c": r"(?m)^#include|\bint main\(", "ruby": r"(?m)^\s*(?:require '|end$)", "php": r"<\?php", "sql": r"(?im)^\s*(?:select|insert|create table)\b",
    "html": r"(?i)<!doctype html|<html", "markdown": r"(?m)^#{1,6} ",
}


def language_of_content(content: Column) -> Column:
    """Language by a first line that names an interpreter, else by most signs; else unknown."""
    first = F.regexp_extract(content, r"^#!.*?\b(python|node|bash|sh|ruby|perl|php|lua)\d*", 1)
    named = F.when(first == "node", "javascript").when(first == "sh", "bash").when(first != "", first)
    counts = F.array(*[F.struct(F.regexp_count(content, F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, p) in enumerate(SIGNS.items())])
    best = F.array_max(counts)
    return F.coalesce(named, F.when(best["n"] > 0, best["name"]), F.lit("unknown"))


def category(path: Column) -> Column:
    lang = language(path)
    return F.when(lang == "unknown", "other").when(lang.isin(*DOCUMENTATION), "documentation").when(lang.isin(*CONFIGURATION), "configuration").when(lang.isin(*DATA), "data").otherwise("code")


def document_type(path: Column) -> Column:
    c = category(path)
    return F.when(c == "documentation", "markdown").when(c == "configuration", "config").otherwise(c)


def supported(path: Column) -> Column:
    return language(path) != "unknown"


def ignored(path: Column, globs: list[str]) -> Column:
    """Path starts with a glob: ``*`` and ``?`` are wild, a trailing slash takes all below."""
    found = F.lit(False)
    for g in globs:
        pattern = g.replace(".", r"\.").replace("*", ".*").replace("?", ".") + (".*" if g.endswith("/") else "")
        found |= path.rlike(f"^(?:{pattern})")
    return found


def binary(content: Column) -> Column:
    """A null character within the first 1,000."""
    return F.instr(F.substring(content, 1, 1000), "\x00") > 0


def line_count(content: Column) -> Column:
    """Lines; a newline at the end starts none."""
    n = F.size(F.split(content, "\n"))
    return F.when(content.isNull() | (content == ""), 0).otherwise(n - content.endswith("\n").cast("int"))


# Chunk types by the first pattern found.
CHUNK_TYPES = (
    ("namespace", r"(?m)^\s*namespace\s+\w+"), ("interface", r"(?m)^\s*interface\s+\w+"), ("class", r"(?m)^\s*(class|struct)\s+\w+"), ("constructor", r"def\s+__init__\s*\(|constructor\s*\("),
    ("function", r"\b(def|function|func|fn)\s+\w+\s*\(|const\s+\w+\s*=\s*\(.*?\)\s*=>"), ("method", r"(?m)^\s{4,}(def|function|func)\s+\w+\s*\("),
    ("property", r"@property|get\s+\w+\s*\(\s*\)|set\s+\w+\s*\("),
)


def chunk_type(content: Column, extension: Column) -> Column:
    """One of 18 types, by content and extension."""
    out = None
    for name, pattern in CHUNK_TYPES:
        out = F.when(content.rlike(pattern), name) if out is None else out.when(content.rlike(pattern), name)
    head, newlines = F.trim(content), F.length(content) - F.length(F.regexp_replace(content, "\n", ""))
    script, typed, prose = extension.isin(".py", ".js", ".ts"), extension.isin(".ts", ".tsx"), extension.isin(".md", ".rst")
    return (
        out.when(content.rlike(r"(?m)^(import|from|require|use|include)") & (newlines < 20), "imports")
        .when(script & content.rlike(r"(?m)^\s*(import|from|export|module)"), "module").when(content.rlike(r"(?m)^[A-Z_]+\s*=|^\s*const\s+[A-Z_]+"), "constants")
        .when(content.rlike(r"(?m)^\s*(type|typedef|interface)\s+") | (typed & content.contains("type ")), "types")
        .when(content.rlike(r"test_|test\(|describe\(|it\(|@Test") | content.contains("unittest") | content.contains("pytest"), "tests")
        .when(prose & F.lower(content).contains("readme"), "readme").when(head.startswith('"""') | head.startswith("'''") | content.rlike(r"/\*\*[\s\S]*?\*/"), "docstring")
        .when(head.startswith("#") | head.startswith("//") | head.startswith("/*"), "comment").when((prose | (extension == ".txt")) & (F.length(content) < 500), "summary").otherwise("unknown")
    )


# What makes code complex, one point for each.
BRANCHES = r"(?i)\b(?:if|else|elif|elsif|for|while|foreach|switch|case|when|try|catch|except|finally)\b|\b\?\s*:|&&|\|\|"
COMMENT = r"^\s*(#|//|/\*|\*|--|;|%)"


def complexity(content: Column) -> Column:
    """One more than the control words and logical operators."""
    return (F.regexp_count(content, F.lit(BRANCHES)) + 1).cast("long")


def filled_lines(content: Column) -> Column:
    return F.size(F.filter(F.split(content, "\n"), lambda x: F.length(F.trim(x)) > 0))


def quality(content: Column, least: int, most: int, lang: Column) -> Column:
    """(score, valid) of a chunk: too small 0.5, too large 0.7, loose indentation 0.9, cut
    strings or comments 0.6, nearly empty 0.3; valid without any problem and above 0.5."""
    n = F.size(F.split(F.trim(content), "\n"))
    few, many, empty = n < least, n > most, F.length(F.trim(content)) < 10
    python = F.lower(lang) == "python"
    braces = F.lower(lang).isin("java", "javascript", "typescript", "c", "cpp")
    loose = python & (F.length(F.trim(content)) > 0) & ~F.substring(content, 1, 1).rlike(r"\s") & content.contains("\n ")
    cut = (python & (F.regexp_count(content, F.lit('"""')) % 2 != 0)) | (braces & (F.regexp_count(content, F.lit(r"/\*")) != F.regexp_count(content, F.lit(r"\*/"))))
    score = F.lit(1.0)
    for ok, factor in ((few, 0.5), (many & ~few, 0.7), (loose, 0.9), (cut, 0.6), (empty, 0.3)):
        score *= F.when(ok, factor).otherwise(1.0)
    return F.struct(score.alias("score"), ((score > 0.5) & ~(few | many | cut | empty)).alias("valid"))
