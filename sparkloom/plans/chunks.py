"""Chunk queries over documents and pages, and packing into budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import files
from ..functions import text as T
from ..operators import chunking, compression, intervals
from .tables import load


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows(load(spark, sf_dir, "documents"), "doc_id", "text", 10, 0.2)


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("digest"))


def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rows = rows.withColumn("start_line", F.col("doc_id") * 100000 + F.col("start_line"))
    return chunking.deduplicated(rows, "source", 5).select("source", "start_line", "end_line")


def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.numbered(load(spark, sf_dir, "documents"), "doc_id", "text").where(~F.col("line").contains("th") | (F.col("line_no") < 3))
    return chunking.islands(rows, "doc_id", 2, 3)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.where(F.col("content").rlike("[0-9]|was|von")).select("doc_id", "line")


def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around those with a digit or one of two words, two before and behind."""
    rows = intervals.line_context(load(spark, sf_dir, "documents"), _targets(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "spans", "lines", F.md5(F.col("context").cast("binary")).alias("digest"))


def line_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the chunks of each document are to its target lines."""
    found = _targets(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("line") + 1)).alias("targets"))  # at most a document's lines
    rows = _chunks(spark, sf_dir).join(found, "doc_id")
    return rows.select("doc_id", "chunk", T.line_proximity(F.col("start_line"), F.col("end_line"), F.col("targets")).alias("score"))


def price_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of price ranges of each order status: a few keys with many intervals."""
    o = load(spark, sf_dir, "orders")
    low = F.floor(F.col("o_totalprice") * 10).cast("long")
    rows = o.select("o_orderstatus", low.alias("start"), (low + F.col("o_orderkey") % 1500).alias("end"))
    return intervals.merged(rows, "o_orderstatus").select("o_orderstatus", "start", "end", "parts")


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.with_context(_chunks(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "start_line", F.length("context").alias("context_chars"))


def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = files.quality(F.col("content"), 4, 8, F.lit("java"))
    return _chunks(spark, sf_dir).select("doc_id", "chunk", F.round(q["score"], 6).alias("score"), q["valid"].alias("valid"))


def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = chunking.metadata(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", m["lines_of_code"].alias("lines_of_code"), m["complexity"].alias("complexity"), F.array_join(m["anti"], ",").alias("anti"))


def line_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.numbered(load(spark, sf_dir, "documents"), "doc_id", "text")
    return chunking.todos(rows, "doc_id")


def line_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.numbered(load(spark, sf_dir, "documents"), "doc_id", "text")
    return chunking.risks(rows, "doc_id").groupBy("risk", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages").select("page_id", F.explode(chunking.tags(F.col("html"))).alias("tag"))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages")
    return rows.select("page_id", F.array_join(chunking.urls(F.col("url")), ",").alias("urls"), F.size(chunking.env_vars(F.col("html"))).alias("n_env"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    rows = d.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("files"), F.sum("n_chars").alias("chars"), (F.count("*") * 2048).alias("estimated_bytes"))
    return rows


def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("source", "doc_id", T.token_estimate(F.col("text")).alias("t"), (F.col("n_chars") % 97).cast("double").alias("score"))
    return compression.packed(rows, "source", "doc_id", "t", "score", 4000)


def batch_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("source", "doc_id", T.token_estimate(F.col("text")).alias("t"))
    return compression.batches(rows, "source", "doc_id", "t", 2000)


def compressed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "chunk", "content", F.lit("other").alias("kind"), ((F.col("chunk") % 10) / 10.0).alias("relevance"))
    return compression.compressed_within(rows, "query_id", "chunk", 1500).select("query_id", "chunk", "tokens", "used")


_L = r"l AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), w0 AS (SELECT doc_id, source, l, unnest(range(0, greatest(len(l), 1), 8)) AS pos FROM l), w AS (SELECT doc_id, source, pos // 8 AS chunk, pos + 1 AS start_line, least(pos + 10, len(l)) AS end_line, array_to_string(l[pos + 1:pos + 10], chr(10)) AS content FROM w0), c AS (SELECT * FROM w WHERE regexp_matches(content, '\S'))"
_N = r"n0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), n AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM n0)"
_CTRL = r"(?i)\b(?:if|else|elif|elsif|for|while|foreach|switch|case|when|try|catch|except|finally)\b|\b\?\s*:|&&|\|\|"
SQL = {
    "line_context": """
      WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) AS n FROM documents),
      t AS (SELECT doc_id, line, n FROM l WHERE regexp_matches(content, '[0-9]|was|von')),
      near AS (SELECT l.doc_id, l.line, l.content, l.n, l.line - row_number() OVER (PARTITION BY l.doc_id ORDER BY l.line) AS island
               FROM l WHERE EXISTS (SELECT 1 FROM t WHERE t.doc_id = l.doc_id AND l.line BETWEEN t.line - 2 AND t.line + 2)),
      marked AS (SELECT *, line = min(line) OVER (PARTITION BY doc_id, island) AND line > 0 AS opens, line = max(line) OVER (PARTITION BY doc_id) AND line < n - 1 AS closes FROM near)
      SELECT doc_id, count(DISTINCT island) AS spans, count(*) AS lines,
             md5(string_agg(CASE WHEN opens THEN '# ...' || chr(10) ELSE '' END || content || CASE WHEN closes THEN chr(10) || '# ...' ELSE '' END, chr(10) ORDER BY line)) AS digest
      FROM marked GROUP BY doc_id""",
    "price_spans": """
      WITH i AS (SELECT o_orderstatus, floor(o_totalprice * 10)::BIGINT AS s, floor(o_totalprice * 10)::BIGINT + o_orderkey % 1500 AS e FROM orders WHERE o_orderkey % 1500 > 0),
      m AS (SELECT *, max(e) OVER (PARTITION BY o_orderstatus ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
      g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderstatus ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
      SELECT o_orderstatus, min(s) AS start, max(e) AS end, count(*) AS parts FROM g GROUP BY o_orderstatus, island""",
    "line_proximity": f"""WITH {_L}, x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
      t AS (SELECT doc_id, line FROM x WHERE regexp_matches(content, '[0-9]|was|von'))
      SELECT c.doc_id, chunk::INT AS chunk, max(CASE WHEN line BETWEEN start_line AND end_line THEN 0.4 WHEN least(abs(line - start_line), abs(line - end_line)) <= 5 THEN 0.3
        WHEN least(abs(line - start_line), abs(line - end_line)) <= 10 THEN 0.2 WHEN least(abs(line - start_line), abs(line - end_line)) <= 20 THEN 0.1 ELSE 0 END)::DOUBLE AS score
      FROM c JOIN t ON c.doc_id = t.doc_id GROUP BY ALL""",
    "chunk_lines": f"WITH {_L} SELECT doc_id, chunk::INT AS chunk, start_line::INT AS start_line, end_line::INT AS end_line, md5(content) AS digest FROM c",
    "chunk_dedup": f"""WITH {_L}, g AS (SELECT source, doc_id * 100000 + start_line AS start_line, end_line, content FROM c WHERE trim(content) <> '' AND len(string_split(content, chr(10))) >= 5)
      SELECT source, start_line, end_line::INT AS end_line FROM g QUALIFY row_number() OVER (PARTITION BY source, trim(content) ORDER BY start_line) = 1""",
    "line_islands": rf"""WITH {_N}, f AS (SELECT * FROM n WHERE regexp_matches(line, '\S') AND (NOT contains(line, 'th') OR line_no < 3)),
      g AS (SELECT *, coalesce((line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 2)::INT, 0) AS new FROM f),
      h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM g)
      SELECT doc_id, island::BIGINT AS island, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines FROM h GROUP BY doc_id, island HAVING count(*) >= 3""",
    "chunk_overlap": rf"""WITH {_L}, b AS (SELECT doc_id, start_line, lag(content) OVER (PARTITION BY doc_id ORDER BY start_line) AS before FROM c)
      SELECT doc_id, start_line::INT AS start_line, coalesce(len(array_to_string(list_filter(string_split(before, chr(10)), lambda x: regexp_matches(x, '^\s*(import|from|class|use|include|#include)\b'))[1:3], chr(10))), 0)::INT AS context_chars FROM b""",
    "chunk_quality": f"""WITH {_L}, q AS (SELECT *, len(string_split(trim(content), chr(10))) AS k, len(trim(content)) < 10 AS tiny FROM c)
      SELECT doc_id, chunk::INT AS chunk, round(CASE WHEN k < 4 THEN 0.5 WHEN k > 8 THEN 0.7 ELSE 1.0 END * CASE WHEN tiny THEN 0.3 ELSE 1.0 END, 6)::DOUBLE AS score, k BETWEEN 4 AND 8 AND NOT tiny AS valid FROM q""",
    "chunk_metadata": rf"""WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l, len(regexp_extract_all(text, '{_CTRL}')) + 1 AS k FROM documents),
      i AS (SELECT *, list_max(list_transform(l, lambda x: len(regexp_extract(x, '^\s*')))) AS indent FROM d)
      SELECT doc_id, len(l)::INT AS lines_of_code, k AS complexity, array_to_string(list_filter([CASE WHEN len(l) > 100 THEN 'long_block' END, CASE WHEN indent > 20 THEN 'deep_nesting' END, CASE WHEN k > 10 THEN 'high_complexity' END], lambda x: x IS NOT NULL), ',') AS anti FROM i""",
    "html_elements": r"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
      SELECT page_id, lower(tag) AS tag, count(*) AS n FROM p GROUP BY ALL""",
    "page_urls": r"SELECT page_id, array_to_string(regexp_extract_all(url, 'https?://[^\s\x22\x27<>)]+'), ',') AS urls, 0 AS n_env FROM pages",
    "corpus_stats": """SELECT lang, source, count(*) AS n, count(DISTINCT doc_id) AS files, sum(n_chars)::BIGINT AS chars, count(*) * 2048 AS estimated_bytes FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""",
    "line_todos": rf"""WITH {_N}, k AS (SELECT *, list_filter({list(chunking.TODO)}, lambda x: contains(upper(line), x))[1] AS kind FROM n)
      SELECT doc_id, line_no, kind, regexp_replace(regexp_replace(regexp_extract(line, '(?i)(?:{'|'.join(chunking.TODO)})[:\s]*(.*)$', 1), '^[/*#\-\s]+', ''), '[*/\s\-]+$', '') AS note FROM k WHERE kind IS NOT NULL""",
    "line_risks": rf"""WITH {_N}, r AS (SELECT doc_id, unnest(list_filter([
        CASE WHEN regexp_matches(upper(line), '\b(SELECT|INSERT|UPDATE|DELETE)\b') AND regexp_matches(line, '[\x22\x27].*(\+|%|\.format\(|\{{)') THEN 'sql_injection' END,
        CASE WHEN ({' OR '.join(f"contains(lower(line), '{w}')" for w in chunking.CREDENTIALS)}) AND contains(line, '=') AND regexp_matches(line, '[\x22\x27]') AND len(line) < 200 AND NOT regexp_matches(lower(line), 'env|config|getenv|environ') THEN 'hardcoded_credential' END,
        CASE WHEN {' OR '.join(f"contains(upper(line), '{w}')" for w in chunking.WEAK)} THEN 'weak_cryptography' END,
        CASE WHEN {' OR '.join(f"contains(line, '{w}')" for w in chunking.UNSAFE)} THEN 'unsafe_deserialization' END], lambda x: x IS NOT NULL)) AS risk FROM n)
      SELECT risk, CASE risk WHEN 'hardcoded_credential' THEN 'critical' WHEN 'weak_cryptography' THEN 'medium' ELSE 'high' END AS severity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM r GROUP BY ALL""",
    "compressed_chunks": rf"""
      WITH RECURSIVE {_L}, z AS (SELECT doc_id, chunk, chunk % 10 / 10.0 AS rel, CASE WHEN chunk % 10 / 10.0 > 0.8 THEN content ELSE substr(content, 1, 2000) END AS content FROM c),
      d AS (SELECT *, len(content) AS n, substr(content, 1, 200) AS s FROM z),
      t AS (SELECT doc_id, chunk, CASE WHEN n = 0 THEN 0 WHEN n > 50000 THEN n // 4 ELSE greatest(1, n // CASE WHEN len(s) - len(regexp_replace(s, '[{{}}()\[\]<>;:=]', '', 'g')) > len(s) * 0.1 THEN 5 WHEN len(s) - len(regexp_replace(s, '[^\x00-\x7F]', '', 'g')) > len(s) * 0.2 THEN 3 ELSE 4 END) END AS t,
            row_number() OVER (PARTITION BY doc_id ORDER BY rel DESC, chunk) AS k FROM d),
      r AS (SELECT doc_id, chunk, k, t, t <= 1500 AS ok, CASE WHEN t <= 1500 THEN t ELSE 0 END AS used FROM t WHERE k = 1
        UNION ALL SELECT t.doc_id, t.chunk, t.k, t.t, r.used + t.t <= 1500, CASE WHEN r.used + t.t <= 1500 THEN r.used + t.t ELSE r.used END FROM r JOIN t ON t.doc_id = r.doc_id AND t.k = r.k + 1)
      SELECT doc_id AS query_id, chunk::INT AS chunk, t::BIGINT AS tokens, used::BIGINT AS used FROM r WHERE ok""",
    "budget_pack": rf"""
      WITH RECURSIVE d AS (SELECT source, doc_id, n_chars % 97 AS score, len(text) AS n, substr(text, 1, 200) AS s FROM documents),
      t AS (SELECT source, doc_id, CASE WHEN n = 0 THEN 0 WHEN n > 50000 THEN n // 4 ELSE greatest(1, n // CASE WHEN len(s) - len(regexp_replace(s, '[{{}}()\[\]<>;:=]', '', 'g')) > len(s) * 0.1 THEN 5 WHEN len(s) - len(regexp_replace(s, '[^\x00-\x7F]', '', 'g')) > len(s) * 0.2 THEN 3 ELSE 4 END) END AS t,
            row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM d),
      r AS (SELECT source, doc_id, k, t, t <= 4000 AS ok, CASE WHEN t <= 4000 THEN t ELSE 0 END AS used FROM t WHERE k = 1
        UNION ALL SELECT t.source, t.doc_id, t.k, t.t, r.used + t.t <= 4000, CASE WHEN r.used + t.t <= 4000 THEN r.used + t.t ELSE r.used END FROM r JOIN t ON t.source = r.source AND t.k = r.k + 1)
      SELECT source, doc_id, t::BIGINT AS tokens, used::BIGINT AS used FROM r WHERE ok""",
    "batch_pack": rf"""
      WITH RECURSIVE d AS (SELECT source, doc_id, len(text) AS n, substr(text, 1, 200) AS s FROM documents),
      t AS (SELECT source, doc_id, CASE WHEN n = 0 THEN 0 WHEN n > 50000 THEN n // 4 ELSE greatest(1, n // CASE WHEN len(s) - len(regexp_replace(s, '[{{}}()\[\]<>;:=]', '', 'g')) > len(s) * 0.1 THEN 5 WHEN len(s) - len(regexp_replace(s, '[^\x00-\x7F]', '', 'g')) > len(s) * 0.2 THEN 3 ELSE 4 END) END AS t,
            row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM d),
      r AS (SELECT source, doc_id, k, t AS used, 0 AS batch FROM t WHERE k = 1
        UNION ALL SELECT t.source, t.doc_id, t.k, CASE WHEN r.used + t.t > 2000 THEN t.t ELSE r.used + t.t END, r.batch + (r.used + t.t > 2000)::INT FROM r JOIN t ON t.source = r.source AND t.k = r.k + 1)
      SELECT source, doc_id, batch FROM r""",
}
QUERIES = {
    f.__name__: f
    for f in (
        chunk_lines, chunk_dedup, line_islands, line_context, line_proximity, price_spans, chunk_overlap, chunk_quality, chunk_metadata, line_todos, line_risks, html_elements, page_urls, corpus_stats,
        budget_pack, batch_pack, compressed_chunks,
    )
}
