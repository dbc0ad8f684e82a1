"""What the first review found to do less than the whole job."""

import hashlib

import corpus_pipeline
from sparkloom.llm import html_text, media, pii

from .conftest import prose


def test_every_repeat_of_a_base_span_is_added(spark):
    rows = [(i, f"call +1 (239) 555-{1000 + i} or mail u{i}.z@m{i}.example.com, or 203.0.113.{i}, ref 4 of 9, version 3.0") for i in range(60)]
    rows += [(100 + i, f"mail kay{i}@m{i}.example.com now, kay{i}@m{i}.example.com today") for i in range(60)]
    field = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    for text, n in (("Call +1 (239) 555-8522 or 2395558522 then again 2395558522 and 2395558522", 3), ("2395558522 and then " * 30 + "+1 (239) 555-8522" + " or 2395558522 then" * 40, 70)):
        found = [text[s:e] for _, s, e in field.added(text, pii.base_spans(text))]
        assert found == ["2395558522"] * n
    text = "jane@ex.org said what Jane, or jane, does; others do not"
    tokens, edges = pii._graph(text, pii.base_spans(text))
    assert [text[s:e] for s, e, _ in tokens] == ["jane@ex.org", "Jane,", "jane,"]
    assert pii._tied(tokens, edges) >= {(1, 1), (2, 1)}


def test_all_sections_of_a_leading_path_are_extracted(spark):
    def page(*posts):
        return "<body><div class=wrap>" + "".join(f"<div class=post><p>{p}</p></div>" for p in posts) + "</div><div><p>Site note.</p></div></body>"

    rows = [(i, "http://h.example/1", page("x" * 90)) for i in range(5)]
    rows += [(8, "http://h.example/2", page("a" * 90, "b" * 90)), (9, "http://h.example/3", page("a" * 90, "b" * 9, "c" * 60))]
    rows += [(20 + i, "http://g.example/1", "<body><div><p>" + "y" * 90 + "</p></div><div><p>Site note.</p></div></body>") for i in range(3)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[0] == "x" * 90 and found[20] == "y" * 90
    assert found[8] == "a" * 90 + "\n" + "b" * 90
    assert found[9] == "\n".join(("a" * 90, "b" * 9, "c" * 60))


def test_rows_of_one_id_may_differ_in_text(spark):
    p, q = prose(8, 900), prose(9, 700)
    rows = [(3, p), (5, p), (5, q), (5, q), (6, q), (None, p), (None, q), (7, None), (7, "")]
    table = media.store(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((r["doc_id"] or -1, r["payload_sha256"]) for r in media.features(table).collect())
    expected = sorted((i or -1, hashlib.sha256(media.payload(t)[1]).hexdigest()) for i, t in rows)
    assert found == expected
    assert table.where("doc_id = 5 and size(borrowed) > 0").count() >= 1


def test_near_dedup_decides_by_row(spark):
    p, q, r = prose(8, 90), prose(9, 70), prose(11, 80)
    rows = [(1, p), (None, p), (None, q), (None, q), (2, r), (2, prose(12, 60)), (3, r), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(x["doc_id"], x["text"]) for x in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    expected = [(1, p), (None, q), (2, r), (2, prose(12, 60)), (3, "")]
    assert sorted(kept, key=str) == sorted(expected, key=str)


def test_names_of_further_columns_are_free(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, __mix_tokens long, __mix_copy string, __gone long, __row long, __text string, __own0 long"
    rows = [(i // 2 if i < 4 else None if i < 6 else i, prose(i // 2, 40), "en", f"s{i % 3}", 9, i, "x", i, i, "t", i) for i in range(12)]
    docs = spark.createDataFrame(rows, names)
    for stage, f in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(f(spark, docs, ""), stage)
        assert docs.columns == [c.split()[0] for c in names.split(", ")]
    found = docs.collect()
    assert found and all(r["__mix_copy"] == "x" and r["__text"] == "t" for r in found)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_heavy_keys_are_dealt_to_many_tasks(spark):
    from sparkloom.llm.common import spread_join

    rows = spark.range(2000).selectExpr("id", "if(id % 4 = 0, concat('k', id), if(id % 50 = 1, null, 'hot')) as k")
    side = rows.where("k is not null").groupBy("k").count().selectExpr("k", "count as uses", "length(k) as n")
    inner, left = spread_join(rows, side, "k", "uses", "id"), spread_join(rows, side, "k", "uses", "id", "left")
    expected = sorted((r["id"], len(r["k"])) for r in rows.where("k is not null").collect())
    assert sorted((r["id"], r["n"]) for r in inner.collect()) == expected
    assert left.count() == 2000 and sorted((r["id"], r["n"]) for r in left.where("n is not null").collect()) == expected


def test_tree_of_hashes_sees_every_root(spark):
    from sparkloom.llm.token_store import _manifest

    rows = [(b, (b << 40) + i, bytes([b, i % 251, i // 251]), 3) for b in (0, 1) for i in range(1500 * (b + 1))]
    schema = "bucket int, key long, root binary, n_tokens long"
    one = {r["bucket"]: r for r in _manifest(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    assert (one[0]["docs"], one[1]["docs"], one[1]["tokens"]) == (1500, 3000, 9000)
    rows[1777] = (*rows[1777][:2], b"other", 3)
    two = {r["bucket"]: r for r in _manifest(spark.createDataFrame(rows, schema)).collect()}
    assert two[0] == one[0] and two[1]["top"] != one[1]["top"]
