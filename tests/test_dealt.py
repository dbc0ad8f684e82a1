"""What a task holds does not grow with the table: rows are dealt in proportion to their number."""

from sparkloom import session
from sparkloom.operators import search, term_index, vector_index
from sparkloom.plans import history, tables


def test_scores_lie_where_documents_do(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} x y w{i % 3}") for i in range(400)], "id long, text string")
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "x w5")], "query_id long, query string")
    whole = sorted(search.bm25(docs, queries, 4).collect())
    monkeypatch.setattr(search, "DOCS", 50)
    asked = queries.selectExpr("query_id", "explode(split(query, ' ')) as term")
    assert search.bm25_scores(docs, asked, ["query_id"], "id", ["text"]).rdd.getNumPartitions() == 8
    assert sorted(search.bm25(docs, queries, 4).collect()) == whole


def test_variations_are_limited_before_they_move(spark, monkeypatch):
    monkeypatch.setattr(search, "DOCS", 50)
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} x", "src") for i in range(400)], "id long, text string, path string")
    asked = spark.createDataFrame([(1, 0, "w1 w2", 1.0), (1, 1, "x", 0.5), (2, 0, "w5", 1.0)], "query_id long, variation int, query string, weight double")
    found = search.lexical(docs, asked, 4)
    assert found._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 4


def test_pairs_of_queries_and_slots_come_in_parts(spark, monkeypatch):
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 9)]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = corpus.selectExpr("id as query_id", "embedding as query_vector")
    whole = sorted(vector_index.exact(vector_index.build(corpus), queries, 3).collect())
    monkeypatch.setattr(vector_index, "CELLS", 16)
    monkeypatch.setattr(vector_index, "PAIRS", 3)
    assert sorted(vector_index.exact(vector_index.build(corpus), queries, 3).collect()) == whole


def test_changes_and_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 1000)
    sf_dir = "/root/testdata/sf0.001"
    n = session.parts(tables.load(spark, sf_dir, "lineitem"))
    assert n > 4
    for rows in (history._changes(spark, sf_dir), tables.edges(spark, sf_dir)):
        assert rows.rdd.getNumPartitions() == n


def test_index_deals_by_range(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(term_index, "RANGE", 25)
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} x y") for i in range(400)], "id long, text string")
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "x w5")], "query_id long, query string")
    index = term_index.TermIndex(spark, str(tmp_path / "index")).build(docs)
    blocks = index._table("blocks", "run").selectExpr("range", "run", "inline(items)")
    assert index.parts == 16 and blocks.selectExpr("range = pmod(xxhash64(key), 16) as ok").where("not ok").isEmpty()
    assert sorted((r["query_id"], r["id"]) for r in index.search(queries, 4).collect()) == sorted((r["query_id"], r["id"]) for r in search.bm25(docs, queries, 4).collect())
