"""Text queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import sessions
from .tables import load, spread


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.crude_estimate(F.col("text")).alias("crude"), T.batch_estimate(F.col("text")).alias("batch"))


def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    cut = [F.md5(T.truncated(F.col("text"), 100, s).cast("binary")).alias(s) for s in ("end", "start", "middle", "smart")]
    return d.select("doc_id", *cut)


def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


def jaccard_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.withColumn("before", before).where("before is not null")
    return rows.select("conv_id", "turn", F.round(T.context_similarity(F.col("text"), F.col("before")), 6).alias("similarity"))


def identifier_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.regexp_replace("p_name", " ", "_"), F.regexp_replace(F.initcap("p_name"), " ", ""), F.regexp_replace("p_name", " ", "-"))).alias("name"))
    n = n.select("p_partkey", F.regexp_replace(F.regexp_replace("name", "#", ""), "[^A-Za-z0-9_-]", "").alias("name")).distinct()
    return n.select("p_partkey", "name", T.style(F.col("name")).alias("style"))


def classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.turn_labels(spread(load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")))
    return rows.select("conv_id", "turn", "task_type", "about_code", "query_type")


def message_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.turn_labels(spread(load(spark, sf_dir, "conversations").select("text")))
    return rows.groupBy("language", "intent").agg(F.count("*").alias("n"))


def query_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang"))
    r = T.relevance(F.col("text"), F.col("path"), F.lit("error in function thing() and the ontion"))
    return d.select("doc_id", F.round(r, 6).alias("relevance"))


def message_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.safe_name(F.col("text")).alias("name"), T.cache_key(F.col("role"), F.col("text")).alias("key"), F.substring("text", 1, 10).alias("head"))


def ids_and_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    x = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    return o.select("o_orderkey", T.display_id(x).alias("display"), T.valid_id(T.display_id(x)).alias("valid"), T.time_ago(F.col("o_orderdate"), F.lit("1999-01-01 00:00:00")).alias("ago"))


_CPT = r"""CASE WHEN len(s) - len(regexp_replace(s, '[{}()\[\]<>;:=]', '', 'g')) > len(s) * 0.1 THEN 5 WHEN len(s) - len(regexp_replace(s, '[^\x00-\x7F]', '', 'g')) > len(s) * 0.2 THEN 3 ELSE 4 END"""
_D = f"d AS (SELECT *, substr(text, 1, 200) AS s, len(text) AS n FROM documents), e AS (SELECT *, {_CPT} AS per FROM d)"
_TYPES = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in parts)} THEN '{name}'" for name, parts in T.TASK_TYPES
) + " ELSE 'research' END"
_CODE = " OR ".join(f"contains(lower(text), '{w}')" for w in T.CODE_WORDS)
_GEN = ", ".join(f"'{w}'" for w in T.GENERATE)
_SPEC = ", ".join(f"'{w}'" for w in T.SPECIFIC)
_BROAD = " OR ".join(f"contains(t, '{w}')" for w in T.BROAD + T.BROAD_PHRASES)
_STOPS = ", ".join(f"'{w}'" for w in T.KEYWORD_STOPS)


def _word(w: str) -> str:
    return f"regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){w.replace(chr(39), chr(39) * 2)}($|[^\\p{{L}}\\p{{N}}_])')::INT"


def _holds(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in parts) + ")"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


SQL = {
    "message_language": rf"""
      WITH c AS (SELECT *, lower(text) AS t FROM conversations), h AS (SELECT *, {' + '.join(map(_word, T.SPANISH))} AS es, {' + '.join(map(_word, T.ENGLISH))} AS en FROM c),
      l AS (SELECT *, CASE WHEN {_holds('t', T.SURE_SPANISH)} THEN 'es' WHEN {_holds('t', T.SURE_ENGLISH)} OR regexp_matches(t, 'the .* needs') THEN 'en' WHEN es > 0 AND en > 0 AND abs(es - en) <= 1 THEN 'es'
                             WHEN en > es THEN 'en' ELSE 'es' END AS language, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS k FROM h),
      i AS (SELECT language, CASE WHEN CASE language WHEN 'es' THEN {_holds('t', T.ASK_FILE['es'])} ELSE {_holds('t', T.ASK_FILE['en'])} END OR regexp_matches(t, '{_quoted(T.GENERATE_PATTERNS)}') THEN 'generation'
                                  WHEN (k < 10 AND contains(t, '?')) OR CASE language WHEN 'es' THEN regexp_matches(t, '{_quoted(T.SIMPLE['es'])}') ELSE regexp_matches(t, '{_quoted(T.SIMPLE['en'])}') END
                                       OR regexp_matches(t, '{_quoted(T.SIMPLE_STARTS)}') THEN 'simple' ELSE 'normal' END AS intent FROM l)
      SELECT language, intent, count(*) AS n FROM i GROUP BY ALL""",
    "query_relevance": rf"""
      WITH q AS (SELECT doc_id, lower(text) AS low, text, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS held, lower(lang) AS name FROM documents),
      p AS (SELECT *, list_filter(held, lambda x: x NOT IN ({', '.join(f"'{w}'" for w in T.RELEVANCE_STOPS)})) AS h FROM q),
      r AS (SELECT doc_id, CASE WHEN contains(low, 'thing') OR contains(low, 'in') THEN 0.3 ELSE 0 END AS f, CASE WHEN len(h) > 0 THEN least(0.15, len(list_intersect(h, ['error', 'function', 'thing', 'ontion'])) / 4 * 0.15) ELSE 0 END AS s,
                   least(0.3, len(list_filter(['error', 'in', 'function', 'thing', 'and', 'the', 'ontion'], lambda x: contains(low, x))) * 0.1) AS m FROM p)
      SELECT doc_id, round(least(1.0, f + s + m)::DOUBLE, 6) AS relevance FROM r""",
    "token_estimate": rf"""WITH {_D} SELECT doc_id, CASE WHEN n = 0 THEN 0 WHEN n > 50000 THEN n // 4 ELSE greatest(1, n // per) END AS tokens, n // 4 AS crude,
      floor(len(regexp_extract_all(substr(text, 1, 1000), '\S+')) * greatest(1.0::DOUBLE, n / 1000) * 1.3::DOUBLE)::BIGINT AS batch FROM e""",
    "truncate_text": f"""WITH {_D}, f AS (SELECT *, n <= CASE WHEN n > 50000 THEN 400 ELSE per * 100 + per - 1 END AS short FROM e)
      SELECT doc_id, md5(CASE WHEN short THEN text ELSE substr(text, 1, per * 100) END) AS "end", md5(CASE WHEN short THEN text ELSE substr(text, n - per * 100 + 1) END) AS start,
        md5(CASE WHEN short THEN text ELSE substr(text, 1, per * 40) || substr(text, n - per * 40 + 1) END) AS middle,
        md5(CASE WHEN short THEN text ELSE substr(text, 1, per * 35) || substr(text, n // 2 - (per * 30) // 2 + 1, per * 30) || substr(text, n - per * 35 + 1) END) AS smart FROM f""",
    "keyword_extract": rf"""
      WITH w AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: trim(x, '.,!?;:()[]{{}}"''')))  AS w, generate_subscripts(regexp_split_to_array(lower(text), '\s+'), 1) AS p FROM documents),
      k AS (SELECT doc_id, w, min(p) AS p FROM w WHERE len(w) > 2 AND w NOT IN ({_STOPS}) GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM k)
      SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS keywords FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND k <= 20 GROUP BY d.doc_id""",
    "jaccard_similarity": r"""
      WITH b AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{4,}')) AS a, list_distinct(regexp_extract_all(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[\p{L}\p{N}_]{4,}')) AS b FROM conversations)
      SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM b WHERE b IS NOT NULL""",
    "identifier_styles": """
      WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') AS a, replace(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), ' ', '') AS b, replace(p_name, ' ', '-') AS c FROM part),
      n AS (SELECT DISTINCT p_partkey, regexp_replace(unnest([a, b, c]), '[^A-Za-z0-9_-]', '', 'g') AS name FROM p)
      SELECT p_partkey, name, CASE WHEN regexp_matches(name, '^[a-z_][a-z0-9_]*$') THEN 'snake' WHEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'camel'
        WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') THEN 'pascal' WHEN regexp_matches(name, '^[a-z]+(-[a-z]+)*$') THEN 'kebab' ELSE 'unknown' END AS style FROM n""",
    "classify_text": rf"""
      WITH c AS (SELECT *, lower(text) AS t, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS parts, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS tokens FROM conversations)
      SELECT conv_id, turn, {_TYPES} AS task_type, {_CODE} AS about_code,
        CASE WHEN list_has_any(parts, [{_GEN}]) THEN 'generation'
             WHEN {_BROAD} OR len(parts) > 50 OR (len(tokens) > 15 AND NOT list_has_any(tokens, [{_SPEC}])) THEN 'general'
             WHEN regexp_matches(text, '\b[a-z][a-z0-9_]+\b') OR regexp_matches(text, '\b[A-Z][a-zA-Z0-9]+(\s|$)') OR regexp_matches(text, ':\d+(\s|$)') OR list_has_any(tokens, [{_SPEC}]) OR len(parts) <= 5 THEN 'specific' ELSE 'general' END AS query_type FROM c""",
    "message_heads": """
      WITH n AS (SELECT *, substr(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50) AS s FROM conversations)
      SELECT conv_id, turn, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS name, sha256(role || '|' || text) AS key, substr(text, 1, 10) AS head FROM n""",
    "ids_and_ages": """
      WITH o AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS x, epoch(TIMESTAMP '1999-01-01' - o_orderdate) AS s FROM orders), d AS (SELECT *, floor(s / 86400)::BIGINT AS days FROM o),
      u AS (SELECT *, CASE WHEN days > 365 THEN days // 365 WHEN days > 30 THEN days // 30 WHEN days > 0 THEN days WHEN s >= 3600 THEN s // 3600 ELSE s // 60 END::BIGINT AS k,
                      CASE WHEN days > 365 THEN 'year' WHEN days > 30 THEN 'month' WHEN days > 0 THEN 'day' WHEN s >= 3600 THEN 'hour' ELSE 'minute' END AS unit FROM d)
      SELECT o_orderkey, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-' || substr(x, 17, 4) || '-' || substr(x, 21) AS display, true AS valid,
             CASE WHEN s < 0 THEN 'in the future' WHEN s < 60 THEN 'just now' ELSE k || ' ' || unit || CASE WHEN k = 1 THEN '' ELSE 's' END || ' ago' END AS ago FROM u""",
}
QUERIES = {
    f.__name__: f
    for f in (
        token_estimate, truncate_text, keyword_extract, jaccard_similarity, identifier_styles, classify_text, message_language, query_relevance, message_heads, ids_and_ages,
    )
}
