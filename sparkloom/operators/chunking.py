"""Texts to chunks: line windows, islands, overlap, validation, and what chunks contain."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import files
from ..functions import text as T
from .brackets import ended
from .pairs import joined

#: Markers of open work, words of credentials, weak algorithms, unsafe calls (fixed values).
TODO = ("TODO", "FIXME", "HACK", "BUG", "OPTIMIZE", "REFACTOR", "NOTE", "WARNING", "XXX")
CREDENTIALS = "password passwd pwd secret api_key apikey access_token auth_token private_key".split()
WEAK = ("MD5", "SHA1", "DES", "RC4", "RC2")
UNSAFE = ("pickle.loads", "eval(", "exec(", "marshal.loads", "yaml.load(", "deserialize(", "unserialize(")
ENV = (r"\$\{([A-Z_][A-Z0-9_]*)\}", r"\$([A-Z_][A-Z0-9_]*)", r"%([A-Z_][A-Z0-9_]*)%", r"\{\{([A-Z_][A-Z0-9_]*)\}\}", r"env\.([A-Z_][A-Z0-9_]*)", r"ENV\[['\"](.*?)['\"]\]")


#: Lines of a chunk and of its overlap by language (fixed values).
SIZES = {"python": (150, 30), "java": (100, 20), "javascript": (120, 24), "typescript": (120, 24), "go": (100, 20), "rust": (100, 20), "markdown": (50, 10)}
#: Sections of documentation and their words (fixed values).
SECTIONS = {
    "installation": "install|setup|getting started", "usage": "usage|how to use|example|quick start", "api": "api|reference|methods|functions",
    "configuration": "config|settings|options", "contributing": "contribut|development|pull request", "license": "license|copyright",
}


def default_size(language: Column) -> Column:
    """(size, overlap) in lines for a language."""
    out = None
    for name, (size, overlap) in SIZES.items():
        row = F.struct(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"))
        out = F.when(language == name, row) if out is None else out.when(language == name, row)
    return out.otherwise(F.struct(F.lit(100).alias("size"), F.lit(20).alias("overlap")))


def adapted_size(stats: DataFrame, size: int = 100, overlap: float = 0.2) -> DataFrame:
    """``strategy, size, overlap`` from ``path, functions, classes, comment_ratio, mean_function,
    longest_function, depth``: smaller chunks for dense code, larger ones for sparse."""
    test = F.lower("path").rlike("test|spec")
    strategy = (
        F.when(test, "balanced").when(F.col("comment_ratio") > 0.3, "documentation").when((F.col("mean_function") > 50) | (F.col("depth") > 10), "dense")
        .when((F.col("functions") < 5) & (F.col("classes") < 2), "sparse").otherwise("balanced")
    )
    rows = stats.withColumn("strategy", strategy)
    by = F.col("strategy")
    n = F.when(by == "dense", int(size * 0.6)).when(by == "sparse", int(size * 1.5)).when(by == "documentation", int(size * 0.8)).otherwise(size)
    n = F.when(test, F.least(n, F.lit(100))).otherwise(n)
    n = F.when(F.col("longest_function") > 100, F.greatest(n, F.lit(150))).otherwise(n)
    share = F.when(by == "dense", min(0.3, overlap * 1.5)).when(by == "sparse", max(0.1, overlap * 0.5)).otherwise(overlap)
    return rows.select("path", "strategy", n.cast("int").alias("size"), share.alias("overlap"))


def documentation(content: Column) -> Column:
    """(sections, completeness) of a documentation text: which of six common sections it has."""
    low = F.lower(content)
    found = F.array_compact(F.array(*[F.when(low.rlike(words), F.lit(name)) for name, words in SECTIONS.items()]))
    return F.struct(found.alias("sections"), (F.size(found) / float(len(SECTIONS))).alias("completeness"))


def lines(content: Column) -> Column:
    return F.split(F.coalesce(content, F.lit("")), "\n")


def windows(docs: DataFrame, key: str, text: str, size: int = 100, overlap: float = 0.2) -> DataFrame:
    """``key, chunk, start_line, end_line, content``: windows of lines that share a part;
    blank ones are left out.  One document's windows are made in one row's place."""
    step = max(1, size - int(size * overlap))
    rows = docs.select(key, lines(F.col(text)).alias("__lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("__lines") - 1, F.lit(0)), F.lit(step))
    rows = rows.select(key, "__lines", F.posexplode(starts).alias("chunk", "__at"))
    part = F.slice("__lines", F.col("__at") + 1, size)
    content = F.array_join(part, "\n")
    rows = rows.select(key, "chunk", (F.col("__at") + 1).alias("start_line"), F.least(F.col("__at") + F.size(part), F.size("__lines")).alias("end_line"), content.alias("content"))
    return rows.where(F.col("content").rlike(r"\S"))


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line``, counted from 1."""
    return docs.select(key, F.posexplode(lines(F.col(text))).alias("__i", "line")).select(key, (F.col("__i") + 1).alias("line_no"), "line")


def islands(rows: DataFrame, key: str, gap: int = 2, least: int = 5) -> DataFrame:
    """Groups of filled lines at most ``gap`` apart, of at least so many lines; ``rows`` has
    ``key, line_no, line``."""
    filled = rows.where(F.col("line").rlike(r"\S"))
    w = Window.partitionBy(key).orderBy("line_no")
    new = (F.col("line_no") - F.lag("line_no").over(w) > gap).cast("int")
    grouped = filled.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn("island", F.sum("__new").over(w))
    out = grouped.groupBy(key, "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines"))
    return out.where(F.col("n_lines") >= least)


def with_context(chunks: DataFrame, key: str, imports: int = 3) -> DataFrame:
    """Each chunk with the first lines of the chunk before it that import or define something."""
    before = F.lag("content").over(Window.partitionBy(key).orderBy("start_line"))
    useful = F.slice(F.filter(lines(before), lambda x: x.rlike(r"^\s*(import|from|class|use|include|#include)\b")), 1, imports)
    return chunks.withColumn("context", F.when(before.isNull(), "").otherwise(F.array_join(useful, "\n")))


def deduplicated(chunks: DataFrame, key: str, least: int = 5) -> DataFrame:
    """Chunks that are not blank nor too short, of equal trimmed content the first of a file."""
    content = F.trim(F.col("content"))
    good = chunks.where((F.length(content) > 0) & (F.size(lines(content)) >= least))
    nth = F.row_number().over(Window.partitionBy(key, F.sha2(content, 256)).orderBy("start_line"))
    return good.withColumn("__nth", nth).where(F.col("__nth") == 1).drop("__nth")


def split_long(chunks: DataFrame, most_tokens: int = 8000) -> DataFrame:
    """Chunks over the tokens cut at line ends into ``_partN`` pieces."""
    size = T.token_estimate(F.col("content"))
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, line: Column) -> Column:
        n = T.token_estimate(line) + 1
        full = (s["n"] + n > most_tokens) & (F.size(s["now"]) > 0)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(line)).otherwise(F.concat(s["now"], F.array(line))).alias("now"), F.when(full, n).otherwise(s["n"] + n).alias("n"),
        )

    cut = F.aggregate(lines(F.col("content")), zero, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    parts = F.when(size > most_tokens, F.transform(cut, lambda p: F.array_join(p, "\n"))).otherwise(F.array("content"))
    rows = chunks.select("*", F.posexplode(parts).alias("part", "piece"))
    return rows.withColumn("content", F.col("piece")).drop("piece")


def todos(rows: DataFrame, key: str) -> DataFrame:
    """``key, line_no, kind, note`` of lines with a marker (the first of the list)."""
    up = F.upper("line")
    kind = None
    for k in TODO:
        kind = F.when(up.contains(k), k) if kind is None else kind.when(up.contains(k), k)
    found = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    note = F.regexp_extract(F.col("line"), rf"(?i)(?:{'|'.join(TODO)})[:\s]*(.*)$", 1)
    note = F.regexp_replace(F.regexp_replace(note, r"^[/*#\-\s]+", ""), r"[*/\s\-]+$", "")
    return found.select(key, "line_no", "kind", note.alias("note"))


def risks(rows: DataFrame, key: str) -> DataFrame:
    """``key, line_no, risk, severity``: SQL built from strings, credentials in code, weak
    algorithms, unsafe calls; one row for each kind that a line shows."""
    line, low, up = F.col("line"), F.lower("line"), F.upper("line")
    secret = F.lit(False)
    for w in CREDENTIALS:
        secret |= low.contains(w)
    secret &= line.contains("=") & line.rlike("[\"']") & (F.length(line) < 200) & ~low.rlike("env|config|getenv|environ")
    sql = up.rlike(r"\b(SELECT|INSERT|UPDATE|DELETE)\b") & line.rlike(r"[\"'].*(\+|%|\.format\(|\{)")
    weak, unsafe = F.lit(False), F.lit(False)
    for w in WEAK:
        weak |= up.contains(w)
    for w in UNSAFE:
        unsafe |= line.contains(w)
    kinds = [F.when(ok, F.struct(F.lit(name).alias("risk"), F.lit(level).alias("severity"))) for ok, name, level in ((sql, "sql_injection", "high"), (secret, "hardcoded_credential", "critical"), (weak, "weak_cryptography", "medium"), (unsafe, "unsafe_deserialization", "high"))]
    return rows.select(key, "line_no", F.explode(F.array_compact(F.array(*kinds))).alias("r")).select(key, "line_no", "r.*")


def env_vars(content: Column) -> Column:
    """Distinct environment variables that a text refers to, in order of patterns."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in ENV]))


def urls(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"https?://[^\s\"'<>)]+"), F.lit(0)))


def metadata(content: Column) -> Column:
    """(lines_of_code, complexity, has_comments, anti) of a chunk, by simple signs."""
    loc = files.filled_lines(content)
    indent = F.array_max(F.transform(F.filter(F.split(content, "\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.length(F.regexp_extract(x, r"^\s*", 0))))
    anti = F.array_compact(F.array(F.when(loc > 100, "long_block"), F.when(indent > 20, "deep_nesting"), F.when(files.complexity(content) > 10, "high_complexity")))
    comments = F.exists(F.split(content, "\n"), lambda x: x.rlike(files.COMMENT))
    return F.struct(loc.alias("lines_of_code"), files.complexity(content).alias("complexity"), comments.alias("has_comments"), anti.alias("anti"))


def imports(rows: DataFrame, key: str, own: list[str]) -> DataFrame:
    """``key, module, internal`` of import lines; own packages and relative ones are internal."""
    module = F.coalesce(
        F.nullif(F.regexp_extract("line", r"^\s*from\s+([\w.]+)\s+import\b", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\s*import\s+([\w.]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract("line", r"^\s*(?:const|let|var)\s+.*=\s*require\(['\"]([^'\"]+)['\"]\)", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\s*import\s+.*from\s+['\"]([^'\"]+)['\"]", 1), F.lit("")),
    )
    found = rows.select(key, module.alias("module")).where(F.col("module").isNotNull()).distinct()
    return found.withColumn("internal", F.col("module").startswith(".") | F.regexp_extract("module", r"^\w+", 0).isin(own))


#: Openings of definitions by language: (pattern with the name in group 1, chunk type).
RULES = {
    "python": ((r"^\s*(?:async\s+)?def\s+(\w+)", "function"), (r"^\s*class\s+(\w+)", "class")),
    "javascript": ((r"^\s*(?:export\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"), (r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)", "class"), (r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(", "function")),
    "typescript": ((r"^\s*(?:export\s+)?(?:async\s+)?function\s*(\w+)", "function"), (r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"^\s*(?:export\s+)?interface\s+(\w+)", "interface"), (r"^\s*(?:export\s+)?type\s+(\w+)", "types")),
    "java": ((r"^\s*(?:public|private|protected)?\s*(?:abstract\s+|final\s+)*class\s+(\w+)", "class"), (r"^\s*(?:public\s+)?interface\s+(\w+)", "interface"), (r"^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(", "method")),
    "csharp": ((r"^\s*namespace\s+([\w.]+)", "namespace"), (r"^\s*(?:public|internal|private)?\s*(?:static\s+|sealed\s+|abstract\s+|partial\s+)*class\s+(\w+)", "class"), (r"^\s*(?:public|private|protected|internal)\s+(?:static\s+|async\s+)*[\w<>\[\]]+\s+(\w+)\s*\(", "method")),
    "go": ((r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "function"), (r"^type\s+(\w+)\s+struct", "class"), (r"^type\s+(\w+)\s+interface", "interface")),
    "rust": ((r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "function"), (r"^\s*(?:pub\s+)?struct\s+(\w+)", "class"), (r"^\s*(?:pub\s+)?trait\s+(\w+)", "interface"), (r"^\s*(?:pub\s+)?mod\s+(\w+)", "module")),
    "c": ((r"^[\w*]+\s+\**(\w+)\s*\([^;]*$", "function"), (r"^\s*(?:typedef\s+)?struct\s+(\w+)", "class")),
    "cpp": ((r"^\s*namespace\s+(\w+)", "namespace"), (r"^\s*class\s+(\w+)", "class"), (r"^[\w:<>*&]+\s+[\w:]*?(\w+)\s*\([^;]*$", "function")),
    "ruby": ((r"^\s*def\s+([\w.?!]+)", "function"), (r"^\s*class\s+(\w+)", "class"), (r"^\s*module\s+(\w+)", "module")),
    "php": ((r"^\s*(?:public|private|protected)?\s*(?:static\s+)?function\s+(\w+)", "function"), (r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)", "class"), (r"^\s*interface\s+(\w+)", "interface")),
    "swift": ((r"^\s*(?:public\s+|private\s+)?func\s+(\w+)", "function"), (r"^\s*(?:public\s+|final\s+)*(?:class|struct)\s+(\w+)", "class"), (r"^\s*protocol\s+(\w+)", "interface")),
    "kotlin": ((r"^\s*(?:private\s+|suspend\s+|override\s+)*fun\s+(\w+)", "function"), (r"^\s*(?:data\s+|open\s+|sealed\s+)?class\s+(\w+)", "class"), (r"^\s*interface\s+(\w+)", "interface")),
    "lua": ((r"^\s*(?:local\s+)?function\s+([\w.:]+)", "function"),), "perl": ((r"^\s*sub\s+(\w+)", "function"), (r"^\s*package\s+([\w:]+)", "module")),
    "r": ((r"^\s*([\w.]+)\s*(?:<-|=)\s*function", "function"),), "bash": ((r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{?", "function"),), "vim": ((r"^\s*fu(?:nction)?!?\s+([\w:#]+)", "function"),),
    "elisp": ((r"^\s*\(defun\s+([\w-]+)", "function"), (r"^\s*\(defvar\s+([\w-]+)", "constants")), "sql": ((r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:table|view|function|procedure)\s+(?:if\s+not\s+exists\s+)?([\w.]+)", "module"),),
    "css": ((r"^\s*([.#@]?[\w-]+[^{]*)\{", "property"),), "html": ((r"(?i)^\s*<(section|article|main|nav|header|footer|form|table)\b", "module"),), "xml": ((r"^\s*<([\w:-]+)[^/>]*>", "module"),),
    "markdown": ((r"^#{1,6}\s+(.+?)\s*$", "readme"),), "json": ((r'^\s{0,4}"([^"]+)"\s*:', "property"),), "yaml": ((r"^([\w.-]+)\s*:", "property"),), "toml": ((r"^\s*\[+([^\]]+)\]+", "namespace"),),
    "ini": ((r"^\s*\[([^\]]+)\]", "namespace"),), "dockerfile": ((r"(?i)^\s*(FROM\s+\S+)", "module"),), "makefile": ((r"^([\w.-]+)\s*:(?!=)", "function"),),
}


def definitions(docs: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """``key, language, chunk_type, name, start_line, end_line``: definitions found by the
    language's rules, each reaching to the line before the next one of the file."""
    rows = docs.select(key, language, F.posexplode(lines(F.col(text))).alias("__i", "line"), F.size(lines(F.col(text))).alias("__n"))
    found = None
    for lang, rules in RULES.items():
        for pattern, kind in rules:
            hit = F.struct(F.lit(kind).alias("chunk_type"), F.regexp_extract("line", pattern, 1).alias("name"))
            cond = (F.col(language) == lang) & F.col("line").rlike(pattern)
            found = F.when(cond, hit) if found is None else found.when(cond, hit)
    rows = rows.withColumn("__hit", found).where(F.col("__hit").isNotNull())
    after = F.lead("__i").over(Window.partitionBy(key).orderBy("__i"))
    return rows.select(key, language, "__hit.chunk_type", "__hit.name", (F.col("__i") + 1).alias("start_line"), F.coalesce(after, F.col("__n")).alias("end_line"))


def nested_definitions(docs: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """``definitions``, but in languages with braces each ends where its body closes, so that they nest."""
    return ended(definitions(docs, key, text, language), docs, key, text, language)


def python_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Functions and classes of Python texts by syntax tree, with their complexity, nesting and
    signature; a text that does not parse gives none."""

    def walk(source: str):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return
        branch = (ast.If, ast.For, ast.While, ast.Try, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension, ast.AsyncFor, ast.Match)
        nest = (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.AsyncFor, ast.AsyncWith, ast.Match)

        def depth(node) -> int:
            return max((depth(c) + isinstance(c, nest) for c in ast.iter_child_nodes(node)), default=0)

        for node in ast.walk(tree):
            if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            inner = list(ast.walk(node))
            function = not isinstance(node, ast.ClassDef)
            yield {
                "chunk_type": "function" if function else "class", "name": node.name, "start_line": start, "end_line": node.end_lineno,
                "complexity": 1 + sum(isinstance(x, branch) for x in inner), "nesting": depth(node), "is_async": isinstance(node, ast.AsyncFunctionDef),
                "is_generator": any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in inner), "decorators": ",".join(ast.unparse(d) for d in node.decorator_list),
                "parameters": ",".join(a.arg for a in node.args.args) if function else "", "returns": ast.unparse(node.returns) if function and node.returns else "",
                "raises": ",".join(sorted({ast.unparse(x.exc.func if isinstance(x.exc, ast.Call) else x.exc) for x in inner if isinstance(x, ast.Raise) and x.exc})),
                "visibility": "private" if node.name.startswith("_") and not node.name.startswith("__") else "public", "calls": ",".join(sorted({x.func.id for x in inner if isinstance(x, ast.Call) and isinstance(x.func, ast.Name)})),
                "bases": "" if function else ",".join(ast.unparse(b) for b in node.bases),
            }

    columns = "chunk_type string, name string, start_line long, end_line long, complexity long, nesting long, is_async boolean, is_generator boolean, decorators string, parameters string, returns string, raises string, visibility string, calls string, bases string"
    names = [c.split()[0] for c in columns.split(", ")]
    kind = docs.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{key: k} | row for k, source in zip(pdf[key], pdf[text]) if source for row in walk(source)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return docs.select(key, text).mapInPandas(parse, f"`{key}` {kind}, {columns}")


def graph_rows(chunks: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """Edges that a chunk's text shows: it contains what it defines, calls, extends, imports."""
    skip = ["if", "for", "while", "return", "print"]
    kinds = {"CONTAINS": r"(?m)^\s*(?:async\s+)?(?:def|class|function|func|fn)\s+(\w+)", "CALLS": r"\b(\w+)\s*\(", "EXTENDS": r"class\s+\w+\s*\(\s*(\w+)", "IMPORTS": r"(?m)^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))"}
    rows = None
    for relation, pattern in kinds.items():
        groups = [F.regexp_extract_all(content, F.lit(pattern), F.lit(g)) for g in ((1, 2) if relation == "IMPORTS" else (1,))]
        one = chunks.select(F.col(path).alias("source_id"), F.explode(F.array_distinct(F.filter(F.concat(*groups), lambda x: (x != "") & ~x.isin(skip)))).alias("target_id"), F.lit(relation).alias("relation_type"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.distinct()


def together(changes: DataFrame, commit: str, path: str) -> DataFrame:
    """``source_id, target_id, relation_type, n``: pairs of files that commits change together."""
    once = changes.select(F.col(commit).alias("c"), F.col(path).alias("file")).distinct()
    pairs = joined(once, once.withColumnRenamed("file", "other")).where("file < other")
    return pairs.groupBy(F.col("file").alias("source_id"), F.col("other").alias("target_id"), F.lit("MODIFIES_TOGETHER").alias("relation_type")).agg(F.count("*").alias("n"))


def tags(html: Column) -> Column:
    """Names of the opening tags of a page, lower-cased, scripts and comments aside."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)


#: What HTML elements are for, by tag, and those that matter most (fixed values).
ELEMENTS = {
    "structure": "header nav main section article aside footer div", "form": "form input select textarea button label", "media": "img video audio picture svg canvas iframe", "table": "table thead tbody tr td th",
    "list": "ul ol li dl dt dd", "heading": "h1 h2 h3 h4 h5 h6", "text": "p span a em strong blockquote code pre", "head": "title meta link script style",
}
SIGNIFICANT = "header nav main section article footer form table h1 h2 title"


def element_kind(tag: Column) -> Column:
    out = None
    for kind, names in ELEMENTS.items():
        hit = tag.isin(names.split())
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def page_quality(html: Column) -> Column:
    """(images, images_without_text, headings, has_title, has_description, has_language, links):
    what accessibility and search engines look at in a page."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    images = F.regexp_extract_all(bare, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    return F.struct(
        F.size(images).alias("images"), F.size(F.filter(images, lambda x: ~x.rlike(r"(?i)\balt\s*="))).alias("images_without_text"), F.regexp_count(bare, F.lit(r"(?i)<h[1-6]\b")).alias("headings"),
        bare.rlike(r"(?is)<title\b[^>]*>\s*\S").alias("has_title"), bare.rlike(r"(?i)<meta\b[^>]*name\s*=\s*[\"']?description").alias("has_description"), bare.rlike(r"(?i)<html\b[^>]*\blang\s*=").alias("has_language"),
        F.regexp_count(bare, F.lit(r"(?i)<a\b[^>]*\bhref\s*=")).alias("links"),
    )


#: Domains of settings by the words of their keys (fixed values).
DOMAINS = {"database": "db database sql postgres mysql redis mongo", "server": "port host server url endpoint", "security": "secret token key password auth ssl", "logging": "log debug level trace"}


def setting_rows(rows: DataFrame, key: str) -> DataFrame:
    """``key, line_no, section, name, value, domain, secret, depth`` of the settings among a
    file's lines (``line_no, line``); the section is the last one named above."""
    line = F.col("line")
    section = F.nullif(F.regexp_extract(line, r"^\s*\[+([^\]]+)\]+\s*$", 1), F.lit(""))
    above = F.last(section, ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    pair = r"^\s*\"?([A-Za-z_][\w.-]*)\"?\s*[:=]\s*(.*?)\s*,?\s*$"
    found = rows.withColumn("section", above).where(line.rlike(pair) & section.isNull())
    name = F.regexp_extract(line, pair, 1)
    words = F.split(F.lower(name), "[_.-]")
    domain = None
    for label, names in DOMAINS.items():
        hit = F.arrays_overlap(words, F.array(*[F.lit(w) for w in names.split()]))
        domain = F.when(hit, label) if domain is None else domain.when(hit, label)
    secret = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ("secret", "token", "password", "key")])) & (F.length(F.regexp_extract(line, pair, 2)) > 0)
    return found.select(key, "line_no", "section", name.alias("name"), F.regexp_extract(line, pair, 2).alias("value"), domain.otherwise("general").alias("domain"), secret.alias("secret"), F.length(F.regexp_extract(line, r"^\s*", 0)).alias("depth"))


def sql_statements(rows: DataFrame, key: str) -> DataFrame:
    """Kind, tables and quality flags of SQL statements (``statement``)."""
    s = F.upper(F.trim("statement"))
    kind = F.regexp_extract(s, r"^(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH)", 1)
    tables = F.array_distinct(F.regexp_extract_all("statement", F.lit(r"(?i)\b(?:from|join|into|update|table)\s+([\w.]+)"), F.lit(1)))
    flags = F.array_compact(F.array(F.when(s.rlike(r"SELECT\s+\*"), "select_star"), F.when(kind.isin("DELETE", "UPDATE") & ~s.contains("WHERE"), "no_where"), F.when(F.regexp_count(s, F.lit(r"\bJOIN\b")) > 4, "many_joins")))
    return rows.select(key, F.lower(kind).alias("kind"), F.array_join(tables, ",").alias("tables"), F.array_join(flags, ",").alias("flags"))
