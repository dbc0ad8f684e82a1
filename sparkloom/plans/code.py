"""Queries over source files: a short file for each part, in five languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import files
from ..functions import text as T
from ..operators import brackets, chunking, compression, events
from .tables import load, spread

EXTENSIONS = ("py", "js", "go", "md", "sql")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"))
    return p.select("p_partkey", "p_size", F.regexp_replace("p_name", " ", "_").alias("fn"), F.regexp_replace(F.initcap("p_name"), " ", "").alias("cls"), F.regexp_replace("p_name", " ", "-").alias("kebab"))


def _python(size: Column) -> Column:
    """A class with one method, which raises, yields or is asynchronous by the part's size."""
    n = lambda k: (size % k).cast("string")
    return F.concat(
        F.lit("import os\nfrom m"), n(4), F.lit(".n import k\n\n"), F.when(size % 2 == 0, "@mark\n").otherwise(""), F.lit("class "), F.col("cls"), F.lit("(Base"), n(3), F.lit("):\n"), F.when(size % 5 == 0, "    async def ").otherwise("    def "), F.col("fn"),
        F.lit("(self, a, b):\n        if a:\n            return g"), n(5), F.lit("(a)\n"), F.when(size % 3 == 0, "        raise ValueError(b)\n").otherwise("        return b\n"),
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p_partkey, p_size, fn, cls, path, ext, content``."""
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = _names(spark, sf_dir).withColumn("ext", ext)
    text = (
        F.when(F.col("ext") == "py", _python(F.col("p_size")))
        .when(F.col("ext") == "js", F.concat(F.lit("// $HOME and ${"), F.upper("fn"), F.lit("}\nexport function "), F.col("fn"), F.lit("() {\n  return 1\n}\n\nclass "), F.col("cls"), F.lit(" {\n}\nconst z = (a) => a\n")))
        .when(F.col("ext") == "go", F.concat(F.lit("package main\nfunc (r T) "), F.col("cls"), F.lit("(a int) {\n}\ntype "), F.col("cls"), F.lit("Row struct {\n}\n")))
        .when(F.col("ext") == "md", F.concat(F.lit("# "), F.col("cls"), F.lit("\ntext\n## Usage\nmore\n## License\nMIT\n")))
        .otherwise(F.concat(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("SELECT * FROM "), F.col("fn"), F.lit(" JOIN other ON a = b"))).otherwise(F.concat(F.lit("delete from "), F.col("fn"))), F.lit("\n")))
    )
    return rows.withColumn("path", F.concat(F.lit("src/"), F.col("fn"), F.col("p_partkey").cast("string"), F.lit("."), F.col("ext"))).withColumn("content", text)


def name_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _names(spark, sf_dir).select("p_partkey", F.explode(F.array("fn", "cls", "kebab")).alias("name"))
    return n.select("p_partkey", "name", F.posexplode(T.variations(F.col("name"))).alias("place", "v")).select("p_partkey", "name", "place", "v.term", "v.kind", "v.confidence")


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike two spellings of a part's name, and of the next part's, are."""
    n = _names(spark, sf_dir)
    after = n.select((F.col("p_partkey") - 1).alias("k"), F.col("cls").alias("other"))
    both = n.join(after, F.col("p_partkey") == F.col("k"))
    return both.select("p_partkey", T.similarity(F.col("fn"), F.col("cls")).alias("own"), T.similarity(F.col("kebab"), F.concat("fn", F.lit("s"))).alias("many"), T.similarity(F.col("fn"), F.col("other")).alias("other"), F.array_join(T.name_words(F.col("cls")), " ").alias("words"))


def definitions_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).withColumn("language", files.language(F.col("path")))
    return chunking.definitions(rows, "path", "content", "language")


def nested_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions by the lines on which their bodies close: each file with one more class around a
    method, whose strings and comments hold braces."""
    more = F.concat(F.lit("class Outer"), "p_partkey", F.lit(" {\n  // }\n  async function in_"), "fn", F.lit("() {\n    return `}\n`\n  }\n  function last({a}) { return '}' }\n}\n"))
    rows = _files(spark, sf_dir).where("ext in ('js', 'go')").withColumn("content", F.when(F.col("ext") == "js", F.concat("content", more)).otherwise(F.col("content")))
    return chunking.nested_definitions(rows.withColumn("language", files.language(F.col("path"))), "path", "content", "language")


def bracket_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether brackets match in files, of which some are damaged, and in documents with letters
    for brackets; with the first error."""
    f = _files(spark, sf_dir)
    kept = F.when(F.col("p_size") % 7 == 0, F.translate("content", "}", "]")).when(F.col("p_size") % 11 == 0, F.regexp_replace("content", r"\}\n$", "")).otherwise(F.col("content"))
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.translate("text", "vpbg", "({})").alias("content"))
    return brackets.checked(f.select("path", kept.alias("content")).unionByName(d), "path", "content")


def python_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.python_chunks(_files(spark, sf_dir).where("ext = 'py'"), "path", "content")


def text_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.graph_rows(_files(spark, sf_dir).where("ext = 'py'").withColumnRenamed("path", "file_path"))


def changed_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "lineitem").where("l_partkey < 400").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").cast("string").alias("path")).distinct()
    return chunking.together(o, "commit_id", "path")


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, content = F.col("path"), F.col("content")
    kinds = [files.language(path).alias("language"), files.category(path).alias("category"), files.document_type(path).alias("kind"), files.language_of_content(content).alias("guess"), files.line_count(content).alias("n_lines"), files.chunk_type(content, F.concat(F.lit("."), "ext")).alias("chunk_type")]
    return _files(spark, sf_dir).select("path", *kinds, files.ignored(path, ["src/cold*", "*.sql"]).alias("ignored"), files.binary(content).alias("binary"))


def file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.imports(chunking.numbered(_files(spark, sf_dir), "path", "content"), "path", ["m1", "m2"])


def file_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment variables, sections of documentation, and what SQL files do."""
    rows = _files(spark, sf_dir)
    d = chunking.documentation(F.col("content"))
    return rows.where("ext in ('js', 'md')").select("path", F.array_join(chunking.env_vars(F.col("content")), ",").alias("env"), F.array_join(d["sections"], ",").alias("sections"), F.round(d["completeness"], 6).alias("completeness"))


def sql_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sql_statements(_files(spark, sf_dir).where("ext = 'sql'").select("path", F.trim(F.regexp_replace("content", "\n", "")).alias("statement")), "path")


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir)
    size = chunking.default_size(files.language(F.col("path")))
    stats = rows.select(
        F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("tests/"), "path")).otherwise(F.col("path")).alias("path"), (F.col("p_size") % 9).alias("functions"), (F.col("p_size") % 4).alias("classes"),
        (F.col("p_size") % 10 / 20).alias("comment_ratio"), (F.col("p_size") * 2).alias("mean_function"), (F.col("p_size") * 3).alias("longest_function"), (F.col("p_size") % 13).alias("depth"),
    )
    own = rows.select(F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("tests/"), "path")).otherwise(F.col("path")).alias("path"), size["size"].alias("default_size"), size["overlap"].alias("default_overlap"))
    return chunking.adapted_size(stats).join(own, "path").select("path", "strategy", "size", F.round("overlap", 6).alias("overlap"), "default_size", "default_overlap")


def long_chunks_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").where("n_chars > 1500").select("doc_id", F.col("text").alias("content"))
    return chunking.split_long(rows, 300).groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.length("content")).alias("chars"))


def compressed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files compressed by their document type at three degrees of relevance."""
    rows = _files(spark, sf_dir).withColumn("kind", files.document_type(F.col("path"))).withColumn("relevance", F.element_at(F.array(F.lit(0.9), F.lit(0.6), F.lit(0.2)), (F.col("p_partkey") % 3 + 1).cast("int")))
    short = compression.compressed(F.col("content"), F.col("kind"), F.col("relevance"))
    asks = compression.should_compress(F.lit("specific"), F.length("content"), F.length("content") / 2, 120, 50)
    return rows.select("path", "kind", short.alias("short"), compression.ratio(F.col("relevance")).alias("ratio"), asks.alias("should"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions, task titles and references to earlier sessions in messages about parts."""
    rows = _names(spark, sf_dir)
    fn, k = F.col("fn"), F.col("p_partkey") % 10
    parts = (
        ("We'll use ", " because it is small. Then go on"), ("@decision: keep ", "\nas it was said to be enough. Done"), ("Security: rotate ", ""), ("implement search using ", ", a core part. It needs care. More"), ("what is ", "?"),
        ("usaré ", " en lugar de otro ya que pesa menos."), ("pattern ", " for events"), ("let's implement the ", " parser. Then test"), ("remember when we fixed it, about the ", " we discussed"), ("sobre la ", " que vimos, lo que hicimos ayer"),
    )
    message = None
    for i, (before, after) in enumerate(parts):
        one = F.concat(F.lit(before), fn, F.lit(after))
        message = F.when(k == i, one) if message is None else message.when(k == i, one)
    d, m = T.decision(F.col("message")), F.col("message")
    found = F.array_join(F.transform(T.references(m), lambda r: F.concat_ws(":", r["pattern"].cast("string"), r["hint"])), ",")
    return rows.withColumn("message", message).select("p_partkey", d["type"].alias("type"), d["title"].alias("title"), d["impact"].alias("impact"), d["rationale"].alias("rationale"), T.task_title(m).alias("task"), T.continues_task(m).alias("goes_on"), found.alias("references"))


def settings_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a configuration file for each part."""
    fn = F.col("fn")
    text = F.concat(F.lit("debug = true\n[server."), fn, F.lit("]\nport = 80"), (F.col("p_size") % 10).cast("string"), F.lit("\n  auth_token: \"x1\"\n[db]\n"), fn, F.lit(" = \nredis_url = r://"), fn, F.lit("\n# end\n"))
    return chunking.setting_rows(chunking.numbered(_names(spark, sf_dir).select("p_partkey", text.alias("content")), "p_partkey", "content"), "p_partkey")


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of pages by kind, and what accessibility looks at."""
    p = load(spark, sf_dir, "pages").select("page_id", "html")
    q = chunking.page_quality(F.col("html"))
    tags = F.transform(chunking.tags(F.col("html")), lambda t: chunking.element_kind(t))
    kinds = [F.size(F.filter(tags, (lambda kind: lambda t: t == kind)(k))).alias(k) for k in ("structure", "text", "list", "heading", "head")]
    return p.select("page_id", *kinds, q["images"].alias("images"), q["images_without_text"].alias("bare_images"), q["has_title"].alias("has_title"), q["has_description"].alias("has_description"), q["has_language"].alias("has_language"), q["links"].alias("links"))


def change_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which change lists are valid: known actions and triggers, at most so many files."""
    e = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.when(F.col("l_linenumber") == 5, "moved").otherwise("modified").alias("action"), F.when(F.col("l_returnflag") == "N", "commit").otherwise("manual").alias("trigger"))
    return events.valid_lists(e, "list_id", "action", "trigger", most=4)


def pattern_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.matching(_files(spark, sf_dir).select("path"), "*bolt1*", 50)


_C = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '')"
_N = "\n"
_S = rf"""p AS (SELECT p_partkey, p_size, replace(p_name, ' ', '_') AS fn, {_C} AS cls, replace(p_name, ' ', '-') AS kebab, string_split(p_name, ' ') AS w, ['py', 'js', 'go', 'md', 'sql'][p_partkey % 5 + 1] AS ext FROM part),
  f AS (SELECT *, 'src/' || fn || p_partkey || '.' || ext AS path, ['python', 'javascript', 'go', 'markdown', 'sql'][p_partkey % 5 + 1] AS language, CASE ext
    WHEN 'py' THEN E'import os\nfrom m' || p_size % 4 || E'.n import k\n\n' || CASE WHEN p_size % 2 = 0 THEN E'@mark\n' ELSE '' END || 'class ' || cls || '(Base' || p_size % 3 || E'):\n' || CASE WHEN p_size % 5 = 0 THEN '    async def ' ELSE '    def ' END || fn
      || E'(self, a, b):\n        if a:\n            return g' || p_size % 5 || E'(a)\n' || CASE WHEN p_size % 3 = 0 THEN E'        raise ValueError(b)\n' ELSE E'        return b\n' END
    WHEN 'js' THEN '// $HOME and ${{' || upper(fn) || E'}}\nexport function ' || fn || E'() {{\n  return 1\n}}\n\nclass ' || cls || E' {{\n}}\nconst z = (a) => a\n'
    WHEN 'go' THEN E'package main\nfunc (r T) ' || cls || E'(a int) {{\n}}\ntype ' || cls || E'Row struct {{\n}}\n'
    WHEN 'md' THEN '# ' || cls || E'\ntext\n## Usage\nmore\n## License\nMIT\n'
    ELSE CASE WHEN p_size % 2 = 0 THEN 'SELECT * FROM ' || fn || ' JOIN other ON a = b' ELSE 'delete from ' || fn END || E'\n' END AS content FROM p)"""
_VARIATIONS = """
  v AS (SELECT p_partkey, fn, cls, kebab, w, lower(w[1]) || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || lower(x[2:])), '') AS camel FROM p),
  r AS (SELECT p_partkey, fn AS name, [fn, camel, cls, kebab, fn || 's', camel || 's', cls || 's'] AS terms, ['original', 'camel', 'pascal', 'kebab', 'plural_snake', 'plural_camel', 'plural_pascal'] AS kinds FROM v
    UNION ALL SELECT p_partkey, cls, [cls, fn, camel, kebab, fn || 's', camel || 's', cls || 's'], ['original', 'snake', 'camel', 'kebab', 'plural_snake', 'plural_camel', 'plural_pascal'] FROM v
    UNION ALL SELECT p_partkey, kebab, [kebab, fn, camel, cls, fn || 's', camel || 's', cls || 's'], ['original', 'snake', 'camel', 'pascal', 'plural_snake', 'plural_camel', 'plural_pascal'] FROM v)"""
_MESSAGE = """CASE p_partkey % 10 WHEN 0 THEN 'We''ll use ' || fn || ' because it is small. Then go on' WHEN 1 THEN '@decision: keep ' || fn || E'\\nas it was said to be enough. Done' WHEN 2 THEN 'Security: rotate ' || fn
  WHEN 3 THEN 'implement search using ' || fn || ', a core part. It needs care. More' WHEN 4 THEN 'what is ' || fn || '?' WHEN 5 THEN 'usaré ' || fn || ' en lugar de otro ya que pesa menos.' WHEN 6 THEN 'pattern ' || fn || ' for events'
  WHEN 7 THEN 'let''s implement the ' || fn || ' parser. Then test' WHEN 8 THEN 'remember when we fixed it, about the ' || fn || ' we discussed' ELSE 'sobre la ' || fn || ' que vimos, lo que hicimos ayer' END"""
SQL = {
    "name_variations": f"WITH {_S}, {_VARIATIONS}, u AS (SELECT p_partkey, name, unnest(range(7))::INT AS place, unnest(terms) AS term, unnest(kinds) AS kind FROM r) SELECT *, CASE WHEN kind = 'original' THEN 1.0 WHEN kind LIKE 'plural%' THEN 0.7 WHEN kind = 'kebab' THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence FROM u",
    "similar_names": f"WITH {_S} SELECT a.p_partkey, 1.0::DOUBLE AS own, 1.0::DOUBLE AS many, CASE WHEN a.fn = b.fn THEN 1.0 ELSE 0.0 END::DOUBLE AS other, lower(array_to_string(a.w, ' ')) AS words FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1",
    "definitions_found": rf"""
      WITH {_S}, l AS (SELECT path, ext, language, string_split(content, chr(10)) AS l FROM f), n AS (SELECT path, ext, language, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l),
      h AS (SELECT *, CASE ext
          WHEN 'py' THEN CASE WHEN regexp_matches(line, '^\s*(async\s+)?def\s+\w+') THEN ['function', regexp_extract(line, 'def\s+(\w+)', 1)] WHEN regexp_matches(line, '^\s*class\s+\w+') THEN ['class', regexp_extract(line, 'class\s+(\w+)', 1)] END
          WHEN 'js' THEN CASE WHEN contains(line, 'function ') THEN ['function', regexp_extract(line, 'function\s+(\w+)', 1)] WHEN regexp_matches(line, '^class') THEN ['class', regexp_extract(line, 'class\s+(\w+)', 1)] WHEN regexp_matches(line, '^const') THEN ['function', 'z'] END
          WHEN 'go' THEN CASE WHEN regexp_matches(line, '^func') THEN ['function', regexp_extract(line, '\)\s*(\w+)\(', 1)] WHEN regexp_matches(line, '^type') THEN ['class', regexp_extract(line, '^type\s+(\w+)', 1)] END
          WHEN 'md' THEN CASE WHEN regexp_matches(line, '^#+ ') THEN ['readme', regexp_extract(line, '^#+\s+(.+)$', 1)] END END AS hit FROM n)
      SELECT path, language, hit[1] AS chunk_type, hit[2] AS name, i AS start_line, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i) - 1, n) AS end_line FROM h WHERE hit IS NOT NULL""",
    "nested_definitions": rf"""
      WITH {_S}, e AS (SELECT path, language, cls, fn, p_partkey, ext, CASE ext WHEN 'js' THEN [['function', fn, '2', '4'], ['class', cls, '6', '7'], ['function', 'z', '8', '8'], ['class', 'Outer' || p_partkey, '9', '16'], ['function', 'in_' || fn, '11', '14'], ['function', 'last', '15', '15']]
        ELSE [['function', cls, '2', '3'], ['class', cls || 'Row', '4', '5']] END AS rows FROM f WHERE ext IN ('js', 'go')),
      r AS (SELECT path, language, unnest(rows) AS r FROM e)
      SELECT path, language, r[1] AS chunk_type, r[2] AS name, r[3]::INT AS start_line, r[4]::INT AS end_line FROM r""",
    "bracket_checks": rf"""
      WITH {_S}, t AS (SELECT path, CASE WHEN p_size % 7 = 0 THEN translate(content, '}}', ']') WHEN p_size % 11 = 0 THEN regexp_replace(content, '\}}\n$', '') ELSE content END AS content FROM f
        UNION ALL SELECT doc_id::VARCHAR, translate(text, 'vpbg', '({{}})') FROM documents),
      l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM t),
      m AS (SELECT path, i, unnest(regexp_extract_all(line, '[\[\](){{}}]')) AS c, generate_subscripts(regexp_extract_all(line, '[\[\](){{}}]'), 1) AS k FROM l WHERE NOT regexp_matches(line, '^ *(#|//|/\*|<!--)')),
      n AS (SELECT path, i, k, c, c IN ('(', '[', '{{') AS up FROM m),
      d AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY i, k ROWS UNBOUNDED PRECEDING) + CASE WHEN up THEN 0 ELSE 1 END AS depth FROM n),
      b AS (SELECT *, lag(c) OVER (PARTITION BY path, depth ORDER BY i, k) AS before FROM d),
      x AS (SELECT *, CASE WHEN up THEN NULL WHEN depth < 1 THEN 'Unexpected closing ' || c WHEN translate(before, '([{{', ')]}}') <> c AND before IN ('(', '[', '{{') THEN 'Mismatched bracket: expected ' || translate(before, '([{{', ')]}}') || ', got ' || c END AS message FROM b),
      e AS (SELECT path, arg_min(message, i * 100000000 + k) FILTER (message IS NOT NULL) AS message, arg_min(i, i * 100000000 + k) FILTER (message IS NOT NULL) AS line,
              sum(CASE WHEN up THEN 1 ELSE -1 END) AS open, arg_max(i, i * 100000000 + k) FILTER (depth = 1) AS low, arg_max(c, i * 100000000 + k) FILTER (depth = 1) AS lowest FROM x GROUP BY path)
      SELECT t.path, message IS NULL AND coalesce(open, 0) <= 0 AS valid, CASE WHEN message IS NOT NULL THEN line WHEN open > 0 THEN low END AS line, CASE WHEN message IS NOT NULL THEN message WHEN open > 0 THEN 'Unclosed ' || lowest END AS message
      FROM t LEFT JOIN e ON e.path = t.path""",
    "python_structure": f"""
      WITH {_S}, m AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS d, CASE WHEN p_size % 3 = 0 THEN 'ValueError' ELSE '' END AS raised FROM f WHERE ext = 'py')
      SELECT path, 'class' AS chunk_type, cls AS name, 4 AS start_line, 8 + d AS end_line, 2 AS complexity, 1 AS nesting, false AS is_async, false AS is_generator, CASE d WHEN 1 THEN 'mark' ELSE '' END AS decorators, '' AS parameters, '' AS returns, raised AS raises,
             'public' AS visibility, CASE raised WHEN '' THEN '' ELSE 'ValueError,' END || 'g' || p_size % 5 AS calls, 'Base' || p_size % 3 AS bases FROM m
      UNION ALL SELECT path, 'function', fn, 5 + d, 8 + d, 2, 1, p_size % 5 = 0, false, '', 'self,a,b', '', raised, 'public', CASE raised WHEN '' THEN '' ELSE 'ValueError,' END || 'g' || p_size % 5, '' FROM m""",
    "text_graph": rf"""
      WITH {_S}, g AS (SELECT path, content FROM f WHERE ext = 'py'),
      r AS (SELECT path, 'CONTAINS' AS relation_type, unnest(regexp_extract_all(content, '(?m)^\s*(?:async\s+)?(?:def|class|function|func|fn)\s+(\w+)', 1)) AS target FROM g
        UNION ALL SELECT path, 'CALLS', unnest(regexp_extract_all(content, '\b(\w+)\s*\(', 1)) FROM g UNION ALL SELECT path, 'EXTENDS', unnest(regexp_extract_all(content, 'class\s+\w+\s*\(\s*(\w+)', 1)) FROM g
        UNION ALL SELECT path, 'IMPORTS', unnest(regexp_extract_all(content, '(?m)^\s*from\s+([\w.]+)\s+import\b', 1)) FROM g UNION ALL SELECT path, 'IMPORTS', unnest(regexp_extract_all(content, '(?m)^\s*import\s+([\w.]+)', 1)) FROM g)
      SELECT DISTINCT path AS source_id, target AS target_id, relation_type FROM r WHERE target NOT IN ('if', 'for', 'while', 'return', 'print', '')""",
    "changed_together": """
      WITH c AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey::VARCHAR AS path FROM lineitem WHERE l_partkey < 400)
      SELECT a.path AS source_id, b.path AS target_id, 'MODIFIES_TOGETHER' AS relation_type, count(*) AS n FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL""",
    "file_kinds": f"""
      WITH {_S} SELECT path, language, CASE ext WHEN 'md' THEN 'documentation' WHEN 'sql' THEN 'data' ELSE 'code' END AS category, CASE ext WHEN 'md' THEN 'markdown' WHEN 'sql' THEN 'data' ELSE 'code' END AS kind,
        CASE WHEN ext = 'sql' AND p_size % 2 = 1 THEN 'unknown' ELSE language END AS guess, CASE ext WHEN 'py' THEN 8 + (p_size % 2 = 0)::INT WHEN 'js' THEN 8 WHEN 'go' THEN 5 WHEN 'md' THEN 6 ELSE 1 END AS n_lines,
        CASE ext WHEN 'md' THEN 'comment' WHEN 'sql' THEN 'unknown' WHEN 'go' THEN 'types' ELSE 'class' END AS chunk_type, path LIKE 'src/cold%' OR path LIKE '%.sql' AS ignored, false AS binary FROM f""",
    "file_imports": f"WITH {_S} SELECT path, 'os' AS module, false AS internal FROM f WHERE ext = 'py' UNION ALL SELECT path, 'm' || p_size % 4 || '.n', p_size % 4 IN (1, 2) FROM f WHERE ext = 'py'",
    "file_settings": f"WITH {_S} SELECT path, CASE ext WHEN 'js' THEN upper(fn) || ',HOME' ELSE '' END AS env, CASE ext WHEN 'md' THEN 'usage,license' ELSE '' END AS sections, round(CASE ext WHEN 'md' THEN 2 ELSE 0 END / 6, 6) AS completeness FROM f WHERE ext IN ('js', 'md')",
    "sql_kinds": f"WITH {_S} SELECT path, CASE WHEN p_size % 2 = 0 THEN 'select' ELSE 'delete' END AS kind, fn || CASE WHEN p_size % 2 = 0 THEN ',other' ELSE '' END AS tables, CASE WHEN p_size % 2 = 0 THEN 'select_star' ELSE 'no_where' END AS flags FROM f WHERE ext = 'sql'",
    "chunk_sizes": f"""
      WITH {_S}, s AS (SELECT CASE WHEN p_size % 7 = 0 THEN 'tests/' ELSE '' END || path AS path, ext, p_size AS z, p_size % 7 = 0 AS test FROM f),
      k AS (SELECT *, CASE WHEN test THEN 'balanced' WHEN z % 10 / 20 > 0.3 THEN 'documentation' WHEN z * 2 > 50 OR z % 13 > 10 THEN 'dense' WHEN z % 9 < 5 AND z % 4 < 2 THEN 'sparse' ELSE 'balanced' END AS strategy FROM s),
      n AS (SELECT *, CASE strategy WHEN 'dense' THEN 60 WHEN 'sparse' THEN 150 WHEN 'documentation' THEN 80 ELSE 100 END AS n FROM k)
      SELECT path, strategy, CASE WHEN z * 3 > 100 THEN greatest(n, 150) ELSE n END AS size, round(CASE strategy WHEN 'dense' THEN 0.3 WHEN 'sparse' THEN 0.1 ELSE 0.2 END::DOUBLE, 6) AS overlap,
        CASE ext WHEN 'py' THEN 150 WHEN 'js' THEN 120 WHEN 'md' THEN 50 ELSE 100 END AS default_size, CASE ext WHEN 'py' THEN 30 WHEN 'js' THEN 24 WHEN 'md' THEN 10 ELSE 20 END AS default_overlap FROM n""",
    "long_chunks_split": rf"""
      WITH RECURSIVE d AS (SELECT doc_id, text AS line, 0 AS i FROM documents WHERE n_chars > 1500 UNION ALL
        SELECT doc_id, unnest(string_split(text, chr(10))), generate_subscripts(string_split(text, chr(10)), 1) FROM documents WHERE n_chars > 1500),
      e AS (SELECT doc_id, i, len(line) AS n, substr(line, 1, 200) AS s FROM d),
      t AS (SELECT doc_id, i, n, CASE WHEN n = 0 THEN 0 WHEN n > 50000 THEN n // 4 ELSE greatest(1, n // CASE WHEN len(s) - len(regexp_replace(s, '[{{}}()\[\]<>;:=]', '', 'g')) > len(s) * 0.1 THEN 5 WHEN len(s) - len(regexp_replace(s, '[^\x00-\x7F]', '', 'g')) > len(s) * 0.2 THEN 3 ELSE 4 END) END AS t FROM e),
      r AS (SELECT doc_id, i, t + 1 AS used, 0 AS part FROM t WHERE i = 1
        UNION ALL SELECT t.doc_id, t.i, CASE WHEN r.used + t.t + 1 > 300 THEN t.t + 1 ELSE r.used + t.t + 1 END, r.part + (r.used + t.t + 1 > 300)::INT FROM r JOIN t ON t.doc_id = r.doc_id AND t.i = r.i + 1),
      p AS (SELECT doc_id, max(part) + 1 AS parts FROM r GROUP BY doc_id)
      SELECT t.doc_id, CASE WHEN t.t > 300 THEN parts ELSE 1 END::BIGINT AS parts, CASE WHEN t.t > 300 THEN t.n - parts + 1 ELSE t.n END::BIGINT AS chars FROM t JOIN p USING (doc_id) WHERE t.i = 0""",
    "compressed_files": f"""
      WITH {_S}, r AS (SELECT *, [0.9, 0.6, 0.2][p_partkey % 3 + 1] AS rel, CASE ext WHEN 'md' THEN 'markdown' WHEN 'sql' THEN 'data' ELSE 'code' END AS kind, string_split(content, chr(10)) AS l FROM f)
      SELECT path, kind, CASE kind
          WHEN 'markdown' THEN CASE WHEN rel > 0.8 THEN rtrim(content, chr(10)) WHEN rel > 0.5 THEN '# ' || cls || E'\\ntext\\n## Usage\\nmore\\n## License\\nMIT' ELSE '# ' || cls || E'\\n## Usage\\n## License' END
          WHEN 'data' THEN CASE WHEN rel > 0.8 THEN content WHEN rel > 0.5 THEN l[1] ELSE '# rows: 2' END
          ELSE CASE WHEN rel > 0.8 THEN content WHEN rel > 0.5 THEN array_to_string(list_filter(l, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(#|//)')), chr(10))
            ELSE CASE ext WHEN 'py' THEN 'class ' || cls || '(Base' || p_size % 3 || E'):\\n' || CASE WHEN p_size % 5 = 0 THEN 'async ' ELSE '' END || 'def ' || fn || '(self, a, b):'
                          WHEN 'js' THEN 'export function ' || fn || E'() {{\\nclass ' || cls || ' {{' ELSE array_to_string(l[1:3], chr(10)) || E'\\n# ...' END END END AS short,
        CASE WHEN rel > 0.8 THEN 0.9 WHEN rel > 0.5 THEN 0.6 ELSE 0.3 END::DOUBLE AS ratio, len(content) / 2 >= 50 AND len(content) > 120 AS should FROM r""",
    "decisions": rf"""
      WITH {_S}, m AS (SELECT *, p_partkey % 10 AS k, {_MESSAGE} AS m FROM p)
      SELECT p_partkey, CASE WHEN k IN (0, 5) THEN 'library' WHEN k IN (1, 3) THEN 'architecture' WHEN k = 2 THEN 'security' WHEN k = 6 THEN 'pattern' END AS type,
        CASE WHEN k IN (0, 5, 6) THEN fn WHEN k = 1 THEN 'keep ' || fn WHEN k = 2 THEN 'rotate ' || fn WHEN k = 3 THEN 'search' END AS title, CASE WHEN k IN (0, 1, 5, 6) THEN 3 WHEN k = 2 THEN 5 WHEN k = 3 THEN 4 END AS impact,
        CASE k WHEN 0 THEN 'it is small' WHEN 1 THEN 'be enough' WHEN 3 THEN 'It needs care' WHEN 5 THEN 'pesa menos' END AS rationale, CASE k WHEN 7 THEN fn || ' parser' END AS task, k = 9 AND false OR regexp_matches(lower(m), 'about the (.+) that') AS goes_on,
        CASE k WHEN 8 THEN '10,11:' || fn || ',15' WHEN 9 THEN '0,2:' || fn ELSE '' END AS "references" FROM m""",
    "settings_found": rf"""
      WITH {_S}, l AS (SELECT p_partkey, fn, p_size, unnest([1, 3, 4, 6, 7]) AS line_no FROM p)
      SELECT p_partkey, line_no, CASE WHEN line_no IN (3, 4) THEN 'server.' || fn WHEN line_no > 4 THEN 'db' END AS section, CASE line_no WHEN 1 THEN 'debug' WHEN 3 THEN 'port' WHEN 4 THEN 'auth_token' WHEN 6 THEN fn ELSE 'redis_url' END AS name,
        CASE line_no WHEN 1 THEN 'true' WHEN 3 THEN '80' || p_size % 10 WHEN 4 THEN '"x1"' WHEN 6 THEN '' ELSE 'r://' || fn END AS value, CASE line_no WHEN 1 THEN 'logging' WHEN 3 THEN 'server' WHEN 4 THEN 'security' WHEN 6 THEN 'general' ELSE 'database' END AS domain,
        line_no = 4 AS secret, CASE line_no WHEN 4 THEN 2 ELSE 0 END AS depth FROM l""",
    "page_elements": r"""
      WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS b FROM pages), t AS (SELECT *, list_transform(regexp_extract_all(b, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)) AS t, regexp_extract_all(b, '(?i)<img\b[^>]*>') AS i FROM b)
      SELECT page_id, len(list_filter(t, lambda x: x IN ('header', 'nav', 'main', 'section', 'article', 'aside', 'footer', 'div'))) AS structure, len(list_filter(t, lambda x: x IN ('p', 'span', 'a', 'em', 'strong', 'blockquote', 'code', 'pre'))) AS text,
        len(list_filter(t, lambda x: x IN ('ul', 'ol', 'li', 'dl', 'dt', 'dd'))) AS list, len(list_filter(t, lambda x: regexp_full_match(x, 'h[1-6]'))) AS heading, len(list_filter(t, lambda x: x IN ('title', 'meta', 'link', 'script', 'style'))) AS head,
        len(i) AS images, len(list_filter(i, lambda x: NOT regexp_matches(x, '(?i)\balt\s*='))) AS bare_images, regexp_matches(b, '(?is)<title\b[^>]*>\s*\S') AS has_title, regexp_matches(b, '(?i)<meta\b[^>]*name\s*=\s*[\x22\x27]?description') AS has_description,
        regexp_matches(b, '(?i)<html\b[^>]*\blang\s*=') AS has_language, len(regexp_extract_all(b, '(?i)<a\b[^>]*\bhref\s*=')) AS links FROM t""",
    "change_checks": """SELECT l_orderkey AS list_id, count(*) AS files, bool_and(l_linenumber <> 5) AND count(*) <= 4 AS valid FROM lineitem GROUP BY l_orderkey""",
    "pattern_files": f"WITH {_S} SELECT path FROM f WHERE contains(path, 'bolt1') ORDER BY path LIMIT 50",
}
QUERIES = {
    f.__name__: f
    for f in (
        name_variations, similar_names, definitions_found, nested_definitions, bracket_checks, python_structure, text_graph, changed_together, file_kinds, file_imports, file_settings, sql_kinds, chunk_sizes, long_chunks_split, compressed_files, decisions,
        settings_found, page_elements, change_checks, pattern_files,
    )
}
