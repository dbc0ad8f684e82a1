"""Each registered query against a plain computation of what can be computed plainly, over
nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from sparkloom.llm import registry


@pytest.fixture(scope="module")
def rows(spark, odd_dir):
    """Result rows of a query over the odd tables, by name; computed once."""
    done = {}

    def run(name):
        if name not in done:
            done[name] = registry.QUERIES[name](spark, odd_dir).collect()
        return done[name]

    return run


def by_id(found, key="doc_id"):
    return {r[key]: r for r in found if r[key] is not None}


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_table(spark, empty_dir, name):
    assert registry.QUERIES[name](spark, empty_dir).count() == 0


def test_op1(rows, docs):
    found = by_id(rows("op1_edit_sketch"))
    assert len(rows("op1_edit_sketch")) == 25
    down = docs[::-1]
    for k, (i, text) in enumerate(down[:-1]):  # the last one is followed by rows without an id
        after = down[k + 1][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i]["near_next"] <= 1 and 0 <= found[i]["near_edited"] <= 1
    assert found[106]["fingerprint"] == found[107]["fingerprint"] != found[104]["fingerprint"]
    assert set(found[100]["fingerprint"]) == {"0"} and found[100]["fingerprint"] == found[101]["fingerprint"]
    assert found[104]["near_edited"] > 0.55


def test_op2(rows):
    found = rows("op2_html_text")
    assert len(found) == 7
    texts = {(r["page_id"], r["url"]): r["text"] for r in found}
    assert texts[1, "http://a.example/x"] == "T & U\nOne two" == texts[2, None]
    assert texts[3, "http://a.example/y"] == "" == texts[4, "odd"]
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_op3(rows, docs):
    found = rows("op3_lm_score")
    assert len(found) == 25
    words = {i: t.encode().lower().split() + [None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    counts = Counter()
    for i, t in docs:
        if not held[i]:
            counts.update(words[i])
    n, v = sum(counts.values()), len(counts)  # rows without an id have crc32 0: held out
    for r in found:
        if r["doc_id"] is None:
            assert r["held_out"]
            continue
        w = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(x in counts for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0


def test_op4(rows, docs):
    found = rows("op4_packing")
    encode = tokenizer("byte_bpe_50k.json")
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    copies = Counter(i for i, _ in docs)
    for i, text in docs:
        ids = np.array(encode.encode(text, add_special_tokens=False).ids + [0], "<u4")
        own = pieces[i]
        assert sum(p["length"] for p in own) == len(ids) * copies[i]
        assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own)
        starts = Counter(x for p in own for x in range(p["start"], p["start"] + p["length"]))
        assert set(starts.values()) == {copies[i]} and len(starts) == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
    assert padding == 0


def test_op5(rows, docs):
    found = by_id(rows("op5_media"))
    assert len(rows("op5_media")) == 25
    for i, text in docs:
        data = text.encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == len(payload) + 44
    assert found[106]["media_sha256"] == found[107]["media_sha256"] and found[106]["feature"] == found[107]["feature"]


def test_op6(rows):
    found = rows("op6_mixing")
    assert len(found) == 25 and all(1 <= r["copies"] <= 2 for r in found)
    assert math.isclose(sum({r["source"]: r["weight"] for r in found}.values()), 1, abs_tol=1e-5)


def test_op7(rows, docs):
    found = rows("op7_token_store")
    encode = tokenizer("word_bpe_49k.json")
    at = sum(r["n_tokens"] for r in found if r["doc_id"] is None)  # rows without an id come first
    places = {(r["doc_id"], r["start"]): r for r in found}
    for i, text in docs:
        ids = np.array(encode.encode(text, add_special_tokens=False).ids + [2], "<u4")
        r = places[i, at]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(found) == 25


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(EMAIL, t)]
    out += [("ip", *m.span()) for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(PHONE, t) if 8 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_op8(rows, docs):
    found = by_id(rows("op8_pii"))
    for i, text in docs:
        assert found[i]["base_sha256"] == hashlib.sha256(plain_spans(text).encode()).hexdigest()
    r = found[108]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1) and r["spans"].count(":") == 8
    assert found[100]["spans"] == "" and len(rows("op8_pii")) == 25


def test_op9(rows):
    found = by_id(rows("op9_language"))
    assert {found[i]["lang_pred"] for i in (100, 101, 102, 103)} == {"und"}
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in rows("op9_language"))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())


def test_op10(rows, docs):
    found = rows("op10_near_duplicates")
    assert len(found) == 25
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(tuple([x]) for x in w)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])


@pytest.mark.parametrize("name", ["op2_html_text", "op4_packing", "op5_media", "op7_token_store", "op10_near_duplicates"])
def test_shuffled_instead_of_broadcast(spark, odd_dir, rows, monkeypatch, name):
    """Beyond the bound of broadcast sides the other way gives the same rows."""
    from sparkloom.llm import common, html_text

    expected = sorted(map(repr, rows(name)))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", -1)
    assert sorted(map(repr, registry.QUERIES[name](spark, odd_dir).collect())) == expected
