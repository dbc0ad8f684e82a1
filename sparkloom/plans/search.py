"""Search queries.  Searches take as queries the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scores, vectors
from ..operators import filters, search, vector_index
from ..operators.term_index import TermIndex
from ..session import scratch
from .tables import EDGES_SQL, load, spread

AS_OF = "2002-01-01 00:00:00"


def _vectors(spark: SparkSession, sf_dir: str):
    e = load(spark, sf_dir, "embeddings")
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    return search.nearest(corpus, queries, 10, 0.5, "vec_id").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def vector_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(vectors.valid(F.col("embedding"), 64)).alias("n_valid"), F.max(F.size("embedding")).alias("dim"),
        F.round(F.avg(vectors.norm(F.col("embedding"))), 6).alias("mean_norm"),
    )


def vector_same_label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    found = search.nearest(corpus, queries, 10, -1.0, "vec_id", metric="cosine").join(corpus.select("vec_id", "label"), "vec_id")
    seed = corpus.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    return found.join(seed, "query_id").groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("wanted")).cast("double")), 6).alias("precision_at_10"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = search.bm25(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), queries, 5, "doc_id")
    return found.select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bm25_topk`` from a stored index."""
    index = TermIndex(spark, scratch(spark, "terms")).build(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    return index.search(_asked(spark, sf_dir), 5, "doc_id").withColumn("score", F.round("score", 5))


def bm25_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents after two feeds: some deleted, some with their source added to the text,
    some copied to new ids; then some of these deleted again and some deleted ones restored."""
    d = spread(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    index = TermIndex(spark, scratch(spark, "terms")).build(d, "doc_id")
    kind = F.when(F.col("doc_id") % 7 == 0, "deleted").when(F.col("doc_id") % 5 == 0, "modified")
    changed = d.select("doc_id", F.concat_ws(" ", "text", "source", "source").alias("text"), kind.alias("action"), F.lit(1).alias("seq")).where("action is not null")
    added = d.where("doc_id % 3 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text", F.lit("added").alias("action"), F.lit(1).alias("seq"))
    index.apply(changed.unionByName(added), "doc_id")
    again = d.where("doc_id % 6 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text", F.lit("deleted").alias("action"), F.lit(1).alias("seq"))
    back = d.where("doc_id % 14 = 0").select("doc_id", "text", F.lit("added").alias("action"), F.lit(2).alias("seq"))
    index.apply(again.unionByName(back).unionByName(back.withColumn("action", F.lit("deleted")).withColumn("seq", F.lit(1))), "doc_id")
    return index.search(_asked(spark, sf_dir), 5, "doc_id").withColumn("score", F.round("score", 5))


def lexical_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text and its first words as a lighter variation, over text and source."""
    b = load(spark, sf_dir, "benchmark").where("item_id % 4 = 0")
    whole = b.select(F.col("item_id").alias("query_id"), F.lit(0).alias("variation"), F.col("text").alias("query"), F.lit(1.0).alias("weight"))
    head = b.select(F.col("item_id").alias("query_id"), F.lit(1).alias("variation"), F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 1, 4), F.concat(F.lit("src"), F.col("item_id").cast("string"))).alias("query"), F.lit(0.9).alias("weight"))
    found = search.lexical(spread(load(spark, sf_dir, "documents").select("doc_id", "text", "source")), whole.unionByName(head), 6, "doc_id", ["text", "source"])
    return found.select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


def _index(spark: SparkSession, sf_dir: str):
    corpus, queries = _vectors(spark, sf_dir)
    return vector_index.build(corpus, "vec_id", carry=("label",)), queries


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine tenths of the ten nearest vectors by scoring under a tenth of
    the pairs, for every fiftieth vector."""
    index, queries = _index(spark, sf_dir)
    rows = vector_index.report(index, queries, 10)
    return rows.select("rows", "queries", (F.col("recall") >= 0.9).alias("reached"), (F.col("scored") < 0.1).alias("few_scored"))


def vector_index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures themselves: recall, parts of the pairs that are scored."""
    return vector_index.report(*_index(spark, sf_dir), 10)


def vector_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of one label, by bounds: the filter comes before any distance."""
    index, queries = _index(spark, sf_dir)
    found = vector_index.exact(index, queries, 3, where="label = 3")
    return found.select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))


def vector_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``vector_topk`` from the index, without scoring all pairs."""
    index, queries = _index(spark, sf_dir)
    found = vector_index.exact(index, queries, 10, 0.5, metric="certainty")
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _two_lists(spark: SparkSession, sf_dir: str):
    o = load(spark, sf_dir, "orders")
    semantic = o.where("o_totalprice >= 100000").select(F.col("o_custkey").alias("query_id"), "o_orderkey", F.col("o_totalprice").alias("score"))
    lexical = o.where("o_orderpriority in ('1-URGENT', '2-HIGH')").select(F.col("o_custkey").alias("query_id"), "o_orderkey", (F.col("o_totalprice") % 1000).alias("score"))
    return semantic, lexical


def minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.fused(*_two_lists(spark, sf_dir), "o_orderkey")
    return rows.select("query_id", "o_orderkey", F.round("score", 6).alias("score"), "source")


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.top(search.fused(*_two_lists(spark, sf_dir), "o_orderkey", 2.0, 2.0), 3, F.desc(F.round("score", 9)), F.col("o_orderkey"))
    return rows.select("query_id", "o_orderkey", "rank", F.round("score", 6).alias("score"))


def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").withColumn("file_path", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt"))))
    spec = {"extensions": ["md"], "languages": ["EN", "de"], "path": r"^SRC[0-4]/"}
    return d.where(filters.predicate(spec, {"language": "lang"}) & filters.safe_path(F.col("file_path"))).select("doc_id", "file_path", "lang")


def date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderkey") % 11 == 0, "not a date").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return o.where(filters.in_dates(raw, "1996-01-01 00:00:00", "1997-12-31 00:00:00")).select("o_orderkey")


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").where("role in ('user', 'assistant') and conv_id <> 1")
    hit = c.where(filters.mentions([F.col("text"), F.col("role")], ["tion", "the", "user"]))
    rows = search.top(hit.withColumn("query_id", F.col("conv_id")), 3, F.desc("turn"), F.col("role"), F.col("text"))
    return rows.select("conv_id", "turn", "role", "rank")


def rerank_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    score = scores.recency(F.col("o_totalprice") / 1000, F.col("o_orderdate"), F.lit(AS_OF), 0.999)
    return o.select("o_orderkey", F.round(score, 6).alias("score"))


def rerank_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").withColumn("score", F.col("p_retailprice") / 2100.0)
    kind = F.when(F.col("p_size") > 40, "class").when(F.col("p_size") > 25, "function").when(F.col("p_size") > 10, "comment").otherwise("other")
    p = p.select(F.col("p_brand").alias("query_id"), "p_partkey", kind.alias("chunk_type"), scores.band(F.col("score")).alias("band"), scores.priority(kind).alias("priority"), "score")
    rows = search.top(p, 1 << 30, F.desc("band"), F.desc("priority"), F.desc("score"), F.col("p_partkey"))
    return rows.select(F.col("query_id").alias("p_brand"), "p_partkey", "chunk_type", "band", "priority", "rank")


def rerank_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("score"))
    recent = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return search.boosted(o, recent, "o_custkey").select("o_orderkey", F.round("score", 4).alias("score"))


def rerank_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "function").when(F.col("o_orderstatus") == "O", "class").otherwise("comment")
    rows = o.select(F.col("o_custkey").alias("query_id"), "o_custkey", "o_orderkey", kind.alias("chunk_type"), scores.recency(F.col("o_totalprice") / 500000, F.col("o_orderdate"), F.lit(AS_OF), 0.9995).alias("score"))
    recent = load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = search.boosted(rows.withColumn("band", scores.band(F.col("score"))).withColumn("priority", scores.priority(F.col("chunk_type"))), recent, "o_custkey")
    rows = search.top(rows, 5, F.desc("band"), F.desc("priority"), F.desc(F.round("score", 9)), F.col("o_orderkey"))
    return rows.select("query_id", "o_orderkey", "chunk_type", "rank", F.round("score", 6).alias("score"))


def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), "source", "doc_id", F.col("n_chars").cast("double").alias("score"))
    return search.diverse(d, "source", "doc_id").select("query_id", "doc_id", "source", "late", "rank")


def two_stage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    again = F.col("score") * 0.5 + F.when(F.col("label") % 2 == 0, 0.5).otherwise(0.0)
    return search.two_stage(corpus, queries, again, 5, "vec_id").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    corpus = corpus.select("vec_id", F.concat(F.lit("p"), (F.col("vec_id") % 200).cast("string")).alias("path"), "embedding")
    from .tables import edges

    return search.graph_expanded(corpus, queries, edges(spark, sf_dir).where("strength >= 0.6"), 9, "vec_id").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"
SQL = {
    "vector_topk": f"""
      WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, (1 + {_COS}) / 2 AS score FROM embeddings a, embeddings q WHERE q.vec_id % 50 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s WHERE score >= 0.5)
      SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "vector_validate": """
      SELECT label, count(*) AS n, count_if(len(embedding) = 64 AND abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-5)::BIGINT AS n_valid,
             max(len(embedding))::INT AS dim, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm
      FROM embeddings GROUP BY label""",
    "vector_same_label_precision": f"""
      WITH s AS (SELECT q.vec_id AS query_id, q.label AS wanted, a.vec_id, a.label, {_COS} AS score FROM embeddings a, embeddings q WHERE q.vec_id % 50 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
      SELECT query_id, round(avg((label = wanted)::INT), 6) AS precision_at_10 FROM r WHERE rank <= 10 GROUP BY query_id""",
    "lexical_variations": r"""
      WITH v AS (SELECT item_id AS query_id, 0 AS variation, text AS query, 1.0 AS weight FROM benchmark WHERE item_id % 4 = 0
        UNION ALL SELECT item_id, 1, array_to_string(regexp_split_to_array(text, '\s+')[1:4], ' ') || ' src' || item_id, 0.9 FROM benchmark WHERE item_id % 4 = 0),
      q AS (SELECT DISTINCT query_id, variation, weight, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS term FROM v),
      c AS (SELECT doc_id, 0 AS col, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents UNION ALL SELECT doc_id, 1, regexp_extract_all(lower(coalesce(source, '')), '[\p{L}\p{N}_]+') FROM documents),
      st AS (SELECT col, count(*) AS n, avg(len(words)) AS mean FROM c GROUP BY col), t AS (SELECT doc_id, col, len(words) AS length, unnest(words) AS term FROM c),
      tf AS (SELECT term, doc_id, col, length, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, col, count(*) AS df FROM tf GROUP BY ALL),
      s AS (SELECT query_id, variation, weight, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
            FROM q JOIN tf USING (term) JOIN df USING (term, col) JOIN st USING (col) GROUP BY ALL),
      f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, variation ORDER BY round(score, 9) DESC, doc_id) <= 4),
      b AS (SELECT query_id, doc_id, max(score * weight) AS score FROM f GROUP BY ALL)
      SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, round(score, 5)::DOUBLE AS score FROM b
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 6""",
    "vector_index_recall": "SELECT count(*) AS rows, count(*) FILTER (vec_id % 50 = 0) AS queries, true AS reached, true AS few_scored FROM embeddings",
    "vector_index_filtered": """
      WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.label = 3)
      SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::INT AS rank, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) <= 3""",
    "bm25_topk": r"""
      WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
      c AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents),
      st AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM c),
      t AS (SELECT doc_id, len(words) AS length, unnest(words) AS term FROM c),
      tf AS (SELECT term, doc_id, length, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
            FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
      SELECT query_id, doc_id, rank::INT AS rank, round(score, 5) AS score FROM r WHERE rank <= 5""",
}
_FUSED = """
  s AS (SELECT o_custkey AS query_id, o_orderkey, o_totalprice AS score FROM orders WHERE o_totalprice >= 100000),
  l AS (SELECT o_custkey AS query_id, o_orderkey, o_totalprice % 1000 AS score FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
  sn AS (SELECT query_id, o_orderkey, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM s WINDOW w AS (PARTITION BY query_id)),
  ln AS (SELECT query_id, o_orderkey, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS l FROM l WINDOW w AS (PARTITION BY query_id)),
  j AS (SELECT query_id, o_orderkey, s, l FROM sn FULL JOIN ln USING (query_id, o_orderkey))"""
SQL |= {
    "minmax_fusion": f"""WITH {_FUSED}
      SELECT query_id, o_orderkey, round(coalesce(s, 0) * 0.7 + coalesce(l, 0) * 0.3, 6) AS score,
             CASE WHEN s IS NULL THEN 'lexical' WHEN l IS NULL THEN 'semantic' ELSE 'hybrid' END AS source FROM j""",
    "hybrid_topk": f"""WITH {_FUSED}, f AS (SELECT query_id, o_orderkey, coalesce(s, 0) * 0.5 + coalesce(l, 0) * 0.5 AS score FROM j),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, o_orderkey) AS rank FROM f)
      SELECT query_id, o_orderkey, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 3""",
    "search_filters": """
      WITH d AS (SELECT doc_id, lang, source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS file_path FROM documents)
      SELECT doc_id, file_path, lang FROM d WHERE file_path LIKE '%.md' AND lang IN ('en', 'de') AND regexp_matches(file_path, '^src[0-4]/', 'i')""",
    "date_filter": """
      SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderkey % 11 <> 0 AND o_orderdate BETWEEN '1996-01-01' AND '1997-12-31')""",
    "keyword_search": """
      WITH h AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant') AND conv_id <> 1 AND (lower(text) LIKE '%tion%' OR lower(text) LIKE '%the%' OR lower(text) LIKE '%user%' OR role LIKE '%user%')),
      r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS rank FROM h)
      SELECT conv_id, turn, role, rank::INT AS rank FROM r WHERE rank <= 3""",
    "rerank_recency": """
      SELECT o_orderkey, round(o_totalprice / 1000 * pow(0.999, floor(epoch(TIMESTAMP '2002-01-01' - o_orderdate) / 86400)), 6) AS score FROM orders""",
    "rerank_bands": """
      WITH p AS (SELECT p_brand, p_partkey, p_retailprice / 2100.0 AS score,
        CASE WHEN p_size > 40 THEN 'class' WHEN p_size > 25 THEN 'function' WHEN p_size > 10 THEN 'comment' ELSE 'other' END AS chunk_type FROM part),
      b AS (SELECT *, floor(score / 0.1::DOUBLE)::BIGINT AS band, CASE chunk_type WHEN 'class' THEN 15 WHEN 'function' THEN 14 WHEN 'comment' THEN 1 ELSE 0 END AS priority FROM p)
      SELECT p_brand, p_partkey, chunk_type, band, priority::INT AS priority,
             (row_number() OVER (PARTITION BY p_brand ORDER BY band DESC, priority DESC, score DESC, p_partkey))::INT AS rank FROM b""",
    "rerank_boost": """
      SELECT o_orderkey, round(CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE o_totalprice * 1.2::DOUBLE END, 4) AS score
      FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey""",
    "rerank_mixed": """
      WITH o AS (SELECT o_custkey AS query_id, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'function' WHEN 'O' THEN 'class' ELSE 'comment' END AS chunk_type,
                 o_totalprice / 500000 * pow(0.9995, floor(epoch(TIMESTAMP '2002-01-01' - o_orderdate) / 86400)) AS score FROM orders),
      b AS (SELECT query_id, o_orderkey, chunk_type, floor(score / 0.1::DOUBLE) AS band, CASE chunk_type WHEN 'function' THEN 14 WHEN 'class' THEN 15 ELSE 1 END AS priority,
                   CASE WHEN c_custkey IS NULL THEN score ELSE score * 1.2::DOUBLE END AS score
            FROM o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON query_id = c_custkey),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY band DESC, priority DESC, round(score, 9) DESC, o_orderkey) AS rank FROM b)
      SELECT query_id, o_orderkey, chunk_type, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "diversity_cap": """
      WITH n AS (SELECT lang AS query_id, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) > 3 AS late FROM documents)
      SELECT query_id, doc_id, source, late, (row_number() OVER (PARTITION BY query_id ORDER BY late, n_chars DESC, doc_id))::INT AS rank FROM n""",
    "two_stage_search": f"""
      WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, a.label, {_COS} AS score FROM embeddings a, embeddings q WHERE q.vec_id % 50 = 0),
      f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r1 FROM s),
      g AS (SELECT query_id, vec_id, score * 0.5 + CASE WHEN label % 2 = 0 THEN 0.5 ELSE 0.0 END AS score FROM f WHERE r1 <= 15),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM g)
      SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
}

SQL["vector_exact"] = SQL["vector_topk"]
SQL["bm25_indexed"] = SQL["bm25_topk"]
SQL["bm25_after_changes"] = SQL["bm25_topk"].replace(
    "documents", """(
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN concat_ws(' ', text, source, source) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 14 = 0
        UNION ALL SELECT doc_id + 10000000, text FROM documents WHERE doc_id % 3 = 0 AND doc_id % 6 <> 0)"""
)

SQL["graph_search"] = f"""WITH {EDGES_SQL}, b AS (SELECT source_id AS node, target_id AS neighbor, strength FROM edges WHERE strength >= 0.6 UNION ALL SELECT target_id, source_id, strength FROM edges WHERE strength >= 0.6),
  hops AS (SELECT node, neighbor, max(strength) AS s FROM b GROUP BY ALL),
  c AS (SELECT vec_id, 'p' || vec_id % 200 AS path, embedding FROM embeddings), s AS (SELECT q.vec_id AS query_id, a.vec_id, a.path, {_COS} AS score FROM c a, c q WHERE q.vec_id % 50 = 0),
  seeds AS (SELECT query_id, vec_id, path FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) <= 3),
  one AS (SELECT seed, h.neighbor AS node, h.s FROM (SELECT DISTINCT path AS seed FROM seeds) JOIN hops h ON h.node = seed WHERE h.s >= 0.3),
  two AS (SELECT seed, h.neighbor AS node FROM one JOIN hops h ON h.node = one.node WHERE one.s * h.s >= 0.3), near AS (SELECT seed, node FROM one UNION SELECT seed, node FROM two WHERE node <> seed),
  held AS (SELECT vec_id, path FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY vec_id) <= 100),
  cand AS (SELECT query_id, vec_id FROM seeds UNION SELECT query_id, held.vec_id FROM seeds JOIN near ON near.seed = seeds.path JOIN held ON held.path = near.node),
  r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM cand JOIN s USING (query_id, vec_id))
  SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 9"""

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_validate, vector_same_label_precision, bm25_topk, bm25_indexed, bm25_after_changes, lexical_variations, vector_index_recall, vector_index_report, vector_index_filtered, vector_exact, minmax_fusion, hybrid_topk, search_filters, date_filter,
        keyword_search, rerank_recency, rerank_bands, rerank_boost, rerank_mixed, diversity_cap, two_stage_search, graph_search,
    )
}
