"""Operators on small tables: edge rows, and what the test tables do not hold."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F
from sparkloom.functions import files, scores, vectors
from sparkloom.functions import text as T
from sparkloom.operators import chunking, compression, context, events, filters, graph, history, insights, plugins, quality, search, sessions
from sparkloom.sources import files as source
from sparkloom.streaming import bus


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_vectors(spark):
    v = F.array(*[F.lit(float(x)) for x in (3, 4)])
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.norm(v)) == 5 and one(spark, vectors.normalized(zero)) == [1.0, 0.0]
    assert abs(one(spark, vectors.cosine(v, zero)) - 0.6) < 1e-12
    assert one(spark, vectors.valid(vectors.normalized(v), 2)) and not one(spark, vectors.valid(v, 2)) and not one(spark, vectors.valid(F.lit(None).cast("array<double>"), 2))


def test_search_of_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, [0.0, 0.0])], "id int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    found = search.nearest(rows, q, 3, 0.0).orderBy("rank").collect()
    assert [r["id"] for r in found] == [9, 5, 4]
    assert search.nearest(rows, q.limit(0), 3).count() == 0 and search.nearest(rows, q, 3, 1.1).count() == 0


def test_nearest_in_parts(spark, monkeypatch):
    """No pairs of rows with all queries: what is ranked is each part's best, whatever its size."""
    for name, value in (("PART", 7), ("SCORES", 20)):
        monkeypatch.setattr(search, name, value)
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)] + [(90, None), (91, [1.0]), (92, [None, 1.0])], "id int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id int, query_vector array<double>")
    found = search.nearest(rows, q, 9, -1.0, metric="cosine")
    assert "CrossJoin" not in planned(found) and "NestedLoop" not in planned(found)
    got = {(r["query_id"], r["rank"]): r["id"] for r in found.collect()}
    assert [got[1, i] for i in range(1, 10)] == [4, 9, 14, 19, 24, 29, 34, 39, 3]
    assert [got[2, i] for i in range(1, 10)] == [0, 5, 10, 15, 20, 25, 30, 35, 1] and len(got) == 18


def test_fusion_edges(spark):
    s = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "z", 3.0)], "query_id int, k string, score double")
    lex = spark.createDataFrame([(1, "b", 2.0), (1, "c", 1.0)], "query_id int, k string, score double")
    found = {(r["query_id"], r["k"]): (round(r["score"], 6), r["source"]) for r in search.fused(s, lex, "k", 7, 3).collect()}
    assert found == {(1, "a"): (0.7, "semantic"), (1, "b"): (1.0, "hybrid"), (1, "c"): (0.0, "lexical"), (2, "z"): (0.7, "semantic")}
    v = search.best_of(spark.createDataFrame([(1, "a", 1.0, 0.8), (1, "a", 0.9, 1.0)], "query_id int, k string, score double, weight double"), "k").first()
    assert v["score"] == 0.9


def test_filters(spark):
    df = spark.createDataFrame([("a.py", None), ("b.PY", "2024-01-05"), ("d/c.ts", "oops")], "file_path string, last_modified string")
    assert df.where(filters.in_dates(F.col("last_modified"), "2024-01-05", "2024-01-05")).count() == 2
    assert df.where(filters.has_extension(F.col("file_path"), ["py"])).count() == 1 and df.where(filters.has_extension(F.col("file_path"), [])).count() == 3
    assert df.where(filters.path_matches(F.col("file_path"), "[")).count() == 3 and df.where(filters.path_matches(F.col("file_path"), r"\.py$")).count() == 2
    safe = {p: one(spark, filters.safe_path(F.lit(p))) for p in ("a/b", "/a", "a/../b", "", "C:x", "a..b")}
    assert safe == {"a/b": True, "/a": False, "a/../b": False, "": False, "C:x": False, "a..b": True}


def test_bands_follow_division(spark):
    assert [one(spark, scores.band(F.lit(x))) for x in (0.3, 0.7, 0.2, 1.0)] == [int(x / 0.1) for x in (0.3, 0.7, 0.2, 1.0)]
    assert one(spark, scores.recency(F.lit(2.0), F.lit(None).cast("timestamp"), F.lit("2024-01-01"))) == 2.0


def edges(spark, rows):
    return spark.createDataFrame(rows, "source_id string, target_id string, relation_type string, strength double")


def test_graph_walk(spark):
    e = edges(spark, [("a", "b", "USES", 0.9), ("b", "c", "USES", 0.9), ("a", "c", "CALLS", 0.2), ("c", "c", "USES", 1.0), ("c", "d", "USES", 0.3), ("x", "a", "USES", 0.5)])
    seeds = spark.createDataFrame([("a",)], "seed string")
    found = {r["node"]: (r["distance"], round(r["strength"], 4)) for r in graph.related(e, seeds, 3, 0.3).collect()}
    assert found == {"b": (1, 0.9), "x": (1, 0.5), "c": (2, 0.81)}  # the weak first way to c does not hide the strong second
    nodes = spark.createDataFrame([("a",), ("alone",)], "id string")
    assert {r["id"]: r["connections"] for r in graph.degrees(nodes, e).collect()} == {"a": 3, "alone": 1}


def test_edges_and_nodes_upsert(spark):
    seen = spark.createDataFrame([("a", "b", "USES", "2024-01-01")] * 7 + [("a", "c", "USES", "2024-01-02")], "source_id string, target_id string, relation_type string, seen_at string")
    found = {r["target_id"]: round(r["strength"], 3) for r in graph.observed(seen).collect()}
    assert found == {"b": 1.0, "c": 0.5}
    again = {r["target_id"]: round(r["strength"], 3) for r in graph.observed(seen.where("target_id = 'c'"), graph.observed(seen)).collect()}
    assert again == {"b": 1.0, "c": 0.6}
    n = spark.createDataFrame([("FILE", "p", 1, "old"), ("FILE", "q", 1, "q")], "node_type string, path string, seen int, name string")
    m = spark.createDataFrame([("FILE", "p", 2, "new")], n.schema)
    assert {r["path"]: r["name"] for r in graph.upserted(n, m, ["node_type", "path"], "seen").collect()} == {"p": "new", "q": "q"}


def test_decay_at_exactly_the_days(spark):
    e = spark.createDataFrame([("a", "b", "USES", 0.12, "2024-01-01 00:00:00"), ("a", "c", "USES", 0.9, "2023-12-31 23:59:59")], "source_id string, target_id string, relation_type string, strength double, last_reinforced string")
    found = {r["target_id"]: (round(r["strength"], 2), r["affected"]) for r in graph.decayed(e, "2024-01-31 00:00:00", ["USES"]).collect()}
    assert found == {"b": (0.12, False), "c": (0.85, True)}


def test_history_edges(spark):
    c = spark.createDataFrame([("f", "s1", "me", "2024-01-01", "fix: x", 1, 1), ("f", "s2", "you", "2024-01-02", "Merge conflict", 500, 500), ("g", "s2", "you", "2024-01-02", "feat y", 1, 0)], "path string, sha string, author string, ts string, message string, insertions int, deletions int").withColumn("ts", F.to_timestamp("ts"))
    sizes = spark.createDataFrame([("f", 10), ("g", 0), ("new", 5)], "path string, lines int")
    found = {r["path"]: (r["volatility"], round(r["stability"], 2), r["conflicts"]) for r in history.volatility(c, sizes, "2024-01-05").collect()}
    assert found == {"f": (1.0, 0.5, 1), "g": (1.0, 0.6, 0), "new": (0.1, 0.96, 0)}
    kinds = [one(spark, history.commit_type(F.lit(m))) for m in ("feat(x): a", "Fix: b", "fixed c", "docs d", "")]
    assert kinds == ["feat", "fix", "other", "docs", "other"]
    risk = {r["path"]: (r["severity"], r["advice"]) for r in history.conflict_risk(c, c.where("path = 'g'")).collect()}
    assert risk == {"f": (9, "review"), "g": (5, "review")}


def test_quality_edges(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, False)], "query_id int, rank int, relevant boolean")
    r = quality.at_k(rows, (1, 2)).first()
    assert (r["precision_at_1"], r["precision_at_2"], r["recall_at_1"], r["recall_at_2"]) == (0.5, 0.25, 1.0, 1.0)
    one_value = quality.latency(spark.createDataFrame([("a", 7.0)], "op string, v double"), "op", "v").first()
    assert (one_value["p50"], one_value["p95"], one_value["p99"]) == (7.0, 7.0, 7.0)
    assert one(spark.createDataFrame([(1,)], "a int").limit(0).sparkSession, F.lit(0.0)) == 0.0


def test_sessions(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "task_id int")
    links = spark.createDataFrame([(1, 10), (1, 11)], "task_id int, session_id int")
    work = spark.createDataFrame([(10, 5, "2024-01-01"), (11, 7, "2024-01-03")], "session_id int, tokens int, ts string")
    made = spark.createDataFrame([(1,), (1,), (1,)], "task_id int")
    rows = {r["task_id"]: (r["sessions"], r["tokens"], r["decisions"]) for r in sessions.task_activity(tasks, links, work, made).collect()}
    assert rows == {1: (2, 12, 3), 2: (0, 0, 0)}  # decisions do not multiply tokens
    assert [one(spark, sessions.severity_rank(F.lit(s))) for s in ("critical", "LOW", "odd")] == [0, 3, 4]


def test_token_estimates(spark):
    texts = ["", "a", "hello world " * 20, "{}();" * 50, "é" * 90, "x" * 50_001]
    assert [one(spark, T.token_estimate(F.lit(t))) for t in texts] == [0, 1, 60, 50, 30, 12_500]
    assert one(spark, F.length(T.truncated(F.lit("abcd" * 100), 10, "middle"))) == 32
    with pytest.raises(ValueError):
        T.truncated(F.lit("x"), 1, "odd")


def parsed(name, style):
    """Words of a name, read character by character."""
    if style in ("snake", "kebab"):
        return [w for w in name.split("_" if style == "snake" else "-") if w]
    words = [""]
    for i, c in enumerate(name):
        starts = c.isupper() and i > 0 and (name[i + 1 : i + 2].islower() or name[i - 1].islower())
        if starts:
            words.append("")
        words[-1] += c
    return [w.lower() for w in words if w]


@pytest.mark.parametrize("name", ["get_user", "parseHTTPResponse", "UserService", "load-file", "items", "XMLHttpRequest", "HTTPServer", "aBC", "x9Y"])
def test_names(spark, name):
    style = one(spark, T.style(F.lit(name)))
    assert one(spark, T.name_words(F.lit(name))) == parsed(name, style)
    terms = [v["term"] for v in one(spark, T.variations(F.lit(name)))]
    assert terms[0] == name and "_".join(parsed(name, style)) in terms


def test_similar_names(spark):
    assert one(spark, T.similarity(F.lit("getUser"), F.lit("get_user"))) == 1.0
    assert one(spark, T.similarity(F.lit("getUsers"), F.lit("get_user"))) == 0.8
    assert one(spark, T.similarity(F.lit("getUser"), F.lit("other"))) == 0.0


def test_classifiers(spark):
    asks = {"please create a parser": "generation", "explain the whole system": "general", "fix total_sum now": "specific"}
    assert {q: one(spark, T.query_type(F.lit(q))) for q in asks} == asks
    assert [one(spark, T.query_language(F.lit(q))) for q in ("I need the list", "hola, qué tal", "zzz", "Necesito la lista para hoy")] == ["en", "es", "es", "es"]
    assert [one(spark, T.task_type(F.lit(q))) for q in ("fix it", "refactor it", "build it", "hm")] == ["debugging", "refactoring", "implementation", "research"]
    assert one(spark, T.task_title(F.lit("Let's implement the parser. Then rest"))) == "parser"
    assert one(spark, T.decision(F.lit("@decision: one table"))["title"]) == "one table"
    assert one(spark, T.decision(F.lit("Security: rotate keys"))["impact"]) == 5 and one(spark, T.decision(F.lit("hm"))) is None
    refs = one(spark, T.references(F.lit("Remember when, in the last session, about the cache we discussed")))
    assert [(r["pattern"], r["hint"]) for r in refs] == [(10, None), (11, "cache"), (12, None)]
    assert one(spark, T.entities(F.lit("see src/a/b.py and run() in B.PY, class Foo"), "files")) == ["src/a/b.py", "b.py"]
    assert [one(spark, T.line_proximity(F.lit(10), F.lit(20), F.array(F.lit(t)))) for t in (15, 24, 29, 39, 99)] == [0.4, 0.3, 0.2, 0.1, 0.0]


def test_kinds_of_files(spark):
    paths = {"a/b.py": "python", "Dockerfile": "dockerfile", "x.UNKNOWN": "unknown", "README": "markdown", "noext": "unknown"}
    assert {p: one(spark, files.language(F.lit(p))) for p in paths} == paths
    chunks = {"class A:\n  pass": "class", "def f(x): pass": "function", "import os": "imports", "MAX = 1": "constants", "# note": "comment", "": "unknown", "namespace x {}": "namespace"}
    assert {c: one(spark, files.chunk_type(F.lit(c), F.lit(".py"))) for c in chunks} == chunks
    assert one(spark, files.ignored(F.lit("build/x.o"), ["build/"])) and not one(spark, files.ignored(F.lit("src/x"), ["*.pyc"]))
    assert [one(spark, files.line_count(F.lit(t))) for t in ("", "a", "a\n", "a\n\nb")] == [0, 1, 1, 3]


def test_chunking(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(25))), (2, ""), (3, None), (4, " \n ")], "id int, text string")
    rows = chunking.windows(docs, "id", "text", 10, 0.2).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in rows] == [(1, 10), (9, 18), (17, 25), (25, 25)]
    long = spark.createDataFrame([(1, "\n".join(["word " * 40] * 30))], "id int, content string")
    parts = chunking.split_long(long, 200).collect()
    assert "\n".join(r["content"] for r in parts) == "\n".join(["word " * 40] * 30) and len(parts) > 5
    code = chunking.numbered(spark.createDataFrame([(1, "# TODO: do this */\nx = 1\npassword = 'hunter2'\neval(x)\nh = md5(x)")], "id int, text string"), "id", "text")
    assert [(r["kind"], r["note"]) for r in chunking.todos(code, "id").collect()] == [("TODO", "do this")]
    assert sorted(r["risk"] for r in chunking.risks(code, "id").collect()) == ["hardcoded_credential", "unsafe_deserialization", "weak_cryptography"]
    imports = chunking.imports(chunking.numbered(spark.createDataFrame([(1, "from a.b import c\nimport os\nfrom .x import y")], "id int, text string"), "id", "text"), "id", ["a"])
    assert {r["module"]: r["internal"] for r in imports.collect()} == {"a.b": True, "os": False, ".x": True}
    assert one(spark, chunking.env_vars(F.lit("${HOME} $PATH %TEMP% ${HOME}"))) == ["HOME", "PATH", "TEMP"]
    s = chunking.sql_statements(spark.createDataFrame([(1, "select * from a join b on x"), (2, "delete from t")], "id int, statement string"), "id").orderBy("id").collect()
    assert [(r["kind"], r["tables"], r["flags"]) for r in s] == [("select", "a,b", "select_star"), ("delete", "t", "no_where")]


def test_python_structure(spark):
    docs = spark.createDataFrame([(1, "@x\ndef f(a):\n    if a and a:\n        raise ValueError(1)\n"), (2, "def ("), (3, None)], "id int, text string")
    r = chunking.python_chunks(docs, "id", "text").collect()
    assert [(x["name"], x["start_line"], x["end_line"], x["complexity"], x["nesting"], x["raises"], x["decorators"]) for x in r] == [("f", 1, 4, 3, 1, "ValueError", "x")]


def test_budget(spark):
    rows = spark.createDataFrame([(1, "a", 60, 0.9), (1, "b", 50, 0.8), (1, "c", 40, 0.7), (1, "big", 500, 1.0), (2, "z", 1, 0.1)], "q int, k string, t int, s double")
    assert sorted((r["q"], r["k"]) for r in compression.packed(rows, "q", "k", "t", "s", 100).collect()) == [(1, "a"), (1, "c"), (2, "z")]
    assert {r["k"]: r["batch"] for r in compression.batches(rows.where("q = 1"), "q", "k", "t", 100).collect()} == {"a": 0, "b": 1, "big": 2, "c": 3}
    code = "# " + "c" * 90 + "\n\n\ndef f():\n    # why\n    return 1"
    got = [one(spark, compression.compressed_code(F.lit(code), F.lit(r))) for r in (0.9, 0.6, 0.1)]
    assert got == ["\ndef f():\n    # why\n    return 1", "def f():\n    return 1", "def f():"]
    assert one(spark, compression.compressed_markdown(F.lit("# A\nx\ny\n## B\nz"), F.lit(0.6))) == "# A\nx\n## B\nz"
    assert one(spark, compression.compressed_data(F.lit("h\n1\n2"), F.lit(0.1))) == "# rows: 3"


def test_events(spark):
    e = spark.createDataFrame([("a", 0.0, 1), ("a", 4.9, 2), ("a", 5.0, 3), ("a", 9.0, 4), ("a", 10.0, 5), ("b", 1.0, 6)], "key string, at double, id int")
    assert sorted(r["id"] for r in events.cooldown(e, ["key"], "at", "id", 5.0).collect()) == [1, 3, 5, 6]
    state = spark.createDataFrame([("x", "indexed", 0), ("y", "indexed", 0)], "path string, action string, seq int")
    feed = spark.createDataFrame([("x", "modified", 1), ("x", "deleted", 2), ("z", "added", 1)], "path string, action string, seq int")
    assert sorted((r["path"], r["action"]) for r in events.apply_feed(state, feed, "path", "action", "seq").collect()) == [("y", "indexed"), ("z", "added")]
    moved = events.renamed(spark.createDataFrame([("a",), ("b",)], "file_path string"), spark.createDataFrame([("a", "c")], "old_path string, new_path string"))
    assert sorted(r["file_path"] for r in moved.collect()) == ["b", "c"]
    t = events.transitions(spark.createDataFrame([(1, 1, "MONITORING"), (1, 2, "DROWSY"), (1, 3, "REM")], "run int, seq int, state string"), "run", "seq", "state")
    assert [r["allowed"] for r in t.orderBy("seq").collect()] == [True, True, False]
    f = spark.createDataFrame([("src/a.py",), ("a.py.bak",), ("b.py",)], "path string")
    assert [r["path"] for r in events.matching(f, "*a.py*").collect()] == ["src/a.py", "a.py.bak"]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [("a", float(x)) for x in (0, 3, 5, 7, 11, 12)] + [("b", 2.0)]
    df = spark.createDataFrame(rows, "key string, at double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = bus.source(spark, f"{tmp_path}/in", df.schema)
    q = bus.cooldown(stream, "key", "at", 5.0).writeStream.format("memory").queryName("cool").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.cooldown(df.withColumn("id", F.lit(0)), ["key"], "at", "id", 5.0)
    assert sorted((r["key"], r["at"]) for r in spark.table("cool").collect()) == sorted((r["key"], r["at"]) for r in batch.collect())
    bus.subscribe(bus.source(spark, f"{tmp_path}/in", df.schema), F.col("key") == "a", bus.upsert_into(f"{tmp_path}/log", "key", "at"), f"{tmp_path}/c2").awaitTermination()
    assert [(r["key"], r["at"]) for r in source.latest(spark.read.parquet(f"{tmp_path}/log"), "key", "at").collect()] == [("a", 12.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, body in {"a.py": b"x = 1\n", "blank.md": b"  \n", "bin.c": b"a\x00b", "bad.txt": b"ok \xff end", "skip.xyz": b"q"}.items():
        (tmp_path / "src" / name).write_bytes(body)
    found = {r["path"].rsplit("/", 1)[1] for r in source.discover(spark, str(tmp_path / "src"), ignore=["blank*"]).collect()}
    assert found == {"a.py", "bin.c", "bad.txt"}
    texts = {r["path"].rsplit("/", 1)[1]: r["content"] for r in source.read_texts(spark, str(tmp_path / "src")).collect()}
    assert texts == {"a.py": "x = 1\n", "bad.txt": "ok  end", "skip.xyz": "q"}
    old = spark.createDataFrame([("k", 1, "a"), ("l", 2, None)], "id string, n int, s string")
    new = spark.createDataFrame([("k", None, "b"), ("m", 3, "c")], "id string, n int, s string")
    assert sorted(tuple(r) for r in source.merged(old, new, "id").collect()) == [("k", 1, "b"), ("l", 2, None), ("m", 3, "c")]
    source.append(new, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_names_without_words(spark):
    for name in ("_", "", "__"):
        assert [v["term"] for v in one(spark, T.variations(F.lit(name)))] == [name]
    assert one(spark, T.first_sentence(F.lit(""))) == "" and one(spark, F.size(T.keywords(F.lit(None).cast("string")))) == 0
    p = events.progress(spark.createDataFrame([("a", 1, 5, 0)], "task string, at long, current long, total long"), "task", "current", "total", "at").first()
    assert p["percent"] is None and p["done"]


def test_context(spark):
    m = spark.createDataFrame([(1, 0, "system", 30), (1, 1, "user", 50), (1, 2, "assistant", 60), (1, 3, "user", 40), (2, 0, "user", 999)], "c int, turn int, role string, t int")
    assert sorted(tuple(r) for r in context.fitting(m, "c", "turn", "role", "t", 120).collect()) == [(1, 0), (1, 1), (1, 3)]
    cycle = lambda total, k, size: tuple(one(spark, context.cycle_budget(F.lit(total), F.lit(k), F.lit(size))))
    assert cycle(131072, 1, "128k") == (117964, 13107, 0) and cycle(32768, 2, "32k")[2] == 1500
    assert cycle(1000, 2, "8k") == (855, 100, 45) and cycle(1000, 1, "8k") == (900, 100, 0) and cycle(40000, 1, "32k") == (28000, 1500, 0)
    got = one(spark, context.expanded(F.lit("call getUser now")))
    assert got[0] == "call getUser now" and "call get_user now" in got and len(got) == 5
    s = one(spark, context.summary(F.lit("Please fix the crash in parser.py today"), F.lit("You should add a test. Then done.")))
    assert s == "[DEBUGGING] | User: Please fix the crash in parser | Context: parser.py | Answer: You should add a test"


def planned(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_expansion_once(spark):
    """A query's names are found, and each name's spellings made, once."""
    plan = planned(spark.range(3).select(context.expanded(F.concat(F.lit("call getUser of my_name "), F.col("id"))).alias("x")))
    assert plan.count("regexp_extract_all") == 1
    assert plan.count("plural_snake") == 1


def test_spellings_once(spark):
    names = spark.range(3).select(F.concat(F.lit("getUser"), F.col("id")).alias("a"), F.lit("get_user").alias("b"))
    assert planned(names.select(T.variations(F.col("a")).alias("x"))).count("RLIKE") <= 8  # a style for the words, and one for all terms
    assert planned(names.select(T.similarity(F.col("a"), F.col("b")).alias("x"))).count("plural_snake") <= 2  # one for each name


def test_insights(spark):
    f = spark.createDataFrame([(1, "Bug", "CRITICAL", "a"), (2, "bug", "LOW", "b"), (3, None, "HIGH", "c")], "id int, type string, severity string, description string")
    assert [r["id"] for r in insights.consolidated(f).collect()] == [1]
    assert {r["category"]: r["markdown"] for r in insights.report(f, "Findings", "id").collect()}["bugs"] == "## Findings: bugs\n- **CRITICAL** a\n- **LOW** b"
    gates = [one(spark, insights.suggests(F.lit(x), F.lit(m), F.lit(None).cast("string"), F.lit(r), F.lit("2024-01-01"))) for x, m, r in ((9.9, "hi", False), (8.0, "fix code", False), (8.0, "hi", False), (9.9, "code", True))]
    assert gates == [True, True, False, False]


def test_models(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], "id int, text string")
    first = plugins.encoded(rows)
    assert first.count() == 2 and plugins.encoded(rows, cache=first).count() == 0
    c = spark.createDataFrame([(1, "a b", "a x", 0.1), (1, "a b", "b a", 0.0)], "query_id int, query string, text string, score double")
    assert {r["text"]: r["score"] for r in plugins.rescored(c, "query", "text").collect()} == {"a x": 0.5, "b a": 1.0}


def test_chunk_sizes_and_documentation(spark):
    rows = [("src/a.py", 9, 3, 0.0, 60.0, 120, 4), ("tests/a.py", 1, 0, 0.9, 1.0, 1, 1), ("b.py", 1, 0, 0.0, 5.0, 5, 2), ("c.py", 1, 0, 0.5, 5.0, 5, 2), ("d.py", 9, 3, 0.0, 5.0, 5, 2)]
    stats = spark.createDataFrame(rows, "path string, functions int, classes int, comment_ratio double, mean_function double, longest_function int, depth int")
    found = {r["path"]: (r["strategy"], r["size"], round(r["overlap"], 2)) for r in chunking.adapted_size(stats, 120, 0.2).collect()}
    assert found == {"src/a.py": ("dense", 150, 0.3), "tests/a.py": ("balanced", 100, 0.2), "b.py": ("sparse", 180, 0.1), "c.py": ("documentation", 96, 0.2), "d.py": ("balanced", 120, 0.2)}
    assert one(spark, chunking.default_size(F.lit("python")))["size"] == 150 and one(spark, chunking.default_size(F.lit("odd")))["overlap"] == 20
    assert one(spark, chunking.documentation(F.lit("## Install\n## License")))["completeness"] == 2 / 6
    texts = {"#!/usr/bin/env python3\nx": "python", "#!/bin/sh": "bash", "package x\nfunc f() {}": "go", "": "unknown", "# Head\n": "markdown", "import os\ndef f():\n": "python"}
    assert {t: one(spark, files.language_of_content(F.lit(t))) for t in texts} == texts


def test_idle_connections(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:30"), ("a", "2024-01-01 00:05:00")], "id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    rows = bus.idle(bus.source(spark, f"{tmp_path}/in", df.schema), "ts", "id")
    rows.writeStream.format("memory").queryName("idle").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["beats"] for r in spark.table("idle").collect()) == [1, 2]
