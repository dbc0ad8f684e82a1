"""The methods themselves, on small inputs and against brute force."""

import itertools
import random

import numpy as np
import pytest
from sparkloom.llm import chunks, edit_sketch, html_text, language, media, minhash, mixing, packing, pii, tokens, token_store

from .conftest import prose


def test_token_ids_are_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = ["", " ", "a  b", "a \n b", "It's I'll DON'T 'S", "x" * 300, "naïve — “q” ＡＢ", "<|endoftext|> a", "12345 3.14", "é é", "\x00a\x01", "ÀÉ÷×ß", "日本語", "\t\n", "a_b__c--d...!!!", "İ ΣΑΣ", prose(1, 400)]
    rng = random.Random(1)
    odd += ["".join(rng.choice("ab '.\n\t12_-éßÄ") for _ in range(rng.randrange(60))) for _ in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        expected = [e.ids for e in Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)]
        enc = tokens.encoder(path)
        assert [x.tolist() for x in enc.many(odd)] == expected
        assert [enc.one(x).tolist() for x in odd] == expected


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - k], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in (0, 20, 100, 300)]
    sig = minhash.signatures(sets + [sets[0][:1]])
    for s, row in zip(sets, sig):
        true = len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s))
        assert abs((row == sig[0]).mean() - true) < 0.12
    assert np.isfinite(sig).all()  # a set of one element fills every slot too


def test_near_groups_in_hot_buckets(spark):
    """A star of near copies whose outer texts are linked to the middle or to each other only."""
    base = [f"w{i}" for i in range(60)]
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = base.copy()
        for j in rng.sample(range(60), rng.randrange(6)):
            words[j] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    top = list(range(60))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(60), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                changed = True
    assert [found[i] for i in range(60)] == top


def test_edit_distance_and_groups(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(2))
        d = plain(a, b)
        assert edit_sketch.edits_within(a, b, d) and (d == 0 or not edit_sketch.edits_within(a, b, d - 1))
    text = prose(1, 300)
    rows = [(1, text), (2, text[:200] + "ZZ" + text[203:]), (3, prose(2, 300)), (4, text), (5, None), (6, "")]
    found = {r["doc_id"]: r["component_id"] for r in edit_sketch.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5}


def test_walks_fall_back_into_step():
    text = prose(5, 500)
    prints = edit_sketch.fingerprints([text, text[:900] + "qq" + text[900:], prose(6, 500), text[::-1]])
    near = (prints[0] == prints).mean(axis=1)
    assert near[1] > 0.7 > 0.4 > near[3]


def test_column_generation():
    demand = {700: 10, 324: 10, 512: 6, 100: 30, 24: 9}
    used = {}
    for pattern, times in packing.patterns(demand, 1024):
        assert sum(n * k for n, k in pattern.items()) <= 1024
        for n, k in pattern.items():
            used[n] = used.get(n, 0) + k * times
    assert all(used[n] <= demand[n] for n in used) and used[700] == 10 and used[512] == 6
    value, best = packing.best_pattern(np.array([3, 5]), np.array([2.0, 4.0]), 11)
    assert value == 8.0 and best @ np.array([3, 5]) <= 11
    plan = packing.Plan(demand, 1024)
    filled = {}
    for n, k in demand.items():
        for rank in range(k):
            pieces = list(plan.pieces(n, rank))
            assert sum(p[1] for p in pieces) == n
            for _, size, seq, off in pieces:
                filled.setdefault(seq, []).append((off, size))
    for own in filled.values():
        end = 0
        for off, size in sorted(own):
            assert off == end
            end += size
        assert end & (end - 1) == 0 and end <= 1024


def test_chunks_are_content_defined_and_checked():
    rng = np.random.default_rng(7)
    body = rng.integers(0, 256, 40_000).astype(np.uint8)
    shifted = np.concatenate([np.array([1, 2, 3], np.uint8), body])
    (a, b), data = chunks.cuts([body, shifted]), (body.tobytes(), shifted.tobytes())
    one, two = chunks.digests(data[0], a, 1), chunks.digests(data[1], b, 1)
    assert len(set(one) & set(two)) > 0.8 * len(one) and a[-1] == 40_000
    assert chunks.cuts([body])[0] == a and chunks.cuts([body[:0]])[0] == []
    assert max(np.diff([0, *a])) <= chunks.MOST
    kept = chunks.kept(data[0], a, 1, [1])
    assert chunks.joined(kept, a, 1, one, [1], {1: data[0][a[0] : a[1]]}) == data[0]
    with pytest.raises(chunks.BrokenChunk):
        chunks.joined(kept, a, 1, one, [1], {1: b"other"})
    assert chunks.root(one) != chunks.root(one[::-1]) and chunks.root([]) == b""


def test_store_keeps_each_chunk_once(spark):
    text = prose(8, 3000)
    rows = [(i, text if i < 30 else text[: 500 * (i % 7 + 1)]) for i in range(40)] + [(99, prose(9, 200))]
    table = media.store(spark.createDataFrame(rows, "doc_id long, text string"))
    held = table.selectExpr("sum(length(body)) as n").first()["n"]
    assert held < 3 * len(text)
    assert media.features(table).select("payload_sha256").distinct().count() == 9
    path = token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), __import__("public_tokenizers").path("word_bpe_49k.json"), 2)
    assert token_store.read_store(spark, path).count() == 41


def test_html_templates():
    page = (
        "<body class='with-sidebar'><header><h1>Site</h1></header><div id='main-nav'><a href=x>m</a></div><div class='wrap'><div class='post'><h2>T &amp; U</h2>"
        "<p>One two three <b>four</b>.<p>Five<br>six<script>if (a < b) {}</script><ul><li>a long item of list<li>b item</ul><div class='share'>Share!</div>"
        "<div class='comments'><p>a very long reader comment that is longer than all of the text</p></div></div><aside>side</aside></div><form>f</form><footer>x</footer>"
    )
    p = html_text.Page(page)
    assert p.text(p.best()) == "T & U\nOne two three four.\nFive six\na long item of list\nb item"
    p = html_text.Page("<main><article><header><h1>Head</h1><div>by line</div></header><section><p>First part here.</p></section><section><p>Second&nbsp;part.</p></section><div role=alert>!</div></article></main>")
    assert p.text(p.best()) == "Head\nFirst part here.\nSecond part."
    p = html_text.Page("<body><div id=wrap><div class='main-content'><h1>Title</h1><div class=entry><p>Long first part of it.</p><p>And more of it.</p></div></div><div id='comments'><p>nice one</p></div></div>")
    assert p.text(p.best()) == "Title\nLong first part of it.\nAnd more of it."
    p = html_text.Page("<body><div><div class=s1><p>" + "a" * 90 + "</p></div><div class=s2><p>" + "b" * 40 + "</p></div></div><div class=ad-slot>Buy</div>")
    assert p.text(p.best()) == "a" * 90 + "\n" + "b" * 40
    p = html_text.Page("<TABLE><TR><TD CLASS=menu><A HREF=x>m</A></TD><TD>Bare &lt;text&gt;<BR>goes   on<!-- no --></TD></TR></TABLE>")
    assert p.text(p.best()) == "Bare <text> goes on"
    assert html_text.Page("").blocks == [] and html_text.Page("<p>").blocks == []


def test_consensus_path_overrules_a_page(spark):
    good = "<div class='a7'><p>{}</p></div><div class='b'><p>{}</p></div>"
    rows = [(i, "http://h.example/1", good.format("x" * 90, "y" * 40)) for i in range(5)] + [(9, "http://h.example/2", good.format("x" * 60, "z" * 70))]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9] == "x" * 60


def test_skip_chain_adds_repeats_only(spark):
    rows = [(i, f"call +1 (239) 555-{1000 + i} or mail u{i}.z@m{i}.example.com, or 203.0.113.{i}, ref 4 of 9, version 3.0") for i in range(60)]
    rows += [(100 + i, f"card 453957876362{1486 if i == 0 else 1000 + i} number {i}") for i in range(30)]
    field = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    text = "Call +1 (239) 555-8522 or 2395558522; see 3.0 and 17 of 99"
    base = pii.base_spans(text)
    assert pii.named(base) == "phone:5:22" and [text[s:e] for _, s, e in field.added(text, base)] == ["2395558522"]
    clean = "Version 3.0 of 2024 has 17 parts, 4 of 9"
    assert pii.base_spans(clean) == [] and field.added(clean, []) == []
    assert pii.masked(text, base) == "Call [PHONE] or 2395558522; see 3.0 and 17 of 99"
    assert pii.base_spans("@a.b x@y x@y.z@q.r 1.2.3.4.5 +49") == [(0, 9, 14), (1, 19, 26)]


def test_languages_held_out(spark):
    rows = [(i, prose(i, 40), "en") for i in range(40)] + [(100 + i, " ".join(w[::-1] + "ö" for w in prose(i, 40).split()), "xx") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, protos = language.prototypes(df.where("doc_id % 3 <> 0"))
    found = language.identify(df, names, protos, keep=["doc_id", "lang"]).where("doc_id % 3 = 0").collect()
    assert names == ["en", "xx"] and all(r["lang"] == r["lang_pred"] for r in found)


def test_exponent(spark):
    shares = spark.createDataFrame([(0.5,), (0.3,), (0.2,)], "share double")
    t = mixing.exponent(shares, limit=1.5)
    assert abs((0.5 / 0.2) ** (1 - t) - 1.5) < 1e-6
    w = np.array([0.5, 0.3, 0.2]) ** mixing.exponent(shares, entropy=1.08)
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.08) < 1e-6
    assert mixing.exponent(shares, limit=9.0) == 0.0 and mixing.exponent(shares, entropy=9.0) == 0.0 and mixing.exponent(shares, entropy=0.1) == 1.0


def test_mixture_meets_weights(spark):
    rows = [(i, prose(i, 5 + i % 11), "big" if i % 10 else "small") for i in range(3000)]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), limit=3.0).collect()
    got = {}
    for r in found:
        got[r["source"]] = got.get(r["source"], 0) + r["__mix_tokens"] * r["__mix_copies"]
    want = {r["source"]: r["__mix_weight"] for r in found}
    assert all(abs(got[s] / sum(got.values()) - want[s]) < 0.005 for s in got)
    assert {r["__mix_copies"] for r in found if r["source"] == "big"} == {1}
