"""Personal data: exact patterns, and a skip-chain conditional random field for repeats.

Four patterns give the base spans.  In documents that have any, tokens with a digit or
an at sign, and repeats of an address's local part, are the nodes of a random field over the labels other, email, ip, card and
phone.  Near neighbours share chain potentials; tokens that repeat each other anywhere
in the document (equal text, equal last digits, an address and its local part) share
skip potentials, occurrence to next occurrence and to the last base-labelled one before it (or
the first after), so edges grow with the tokens.  Loopy
belief propagation spreads what the patterns know, and tokens that end up
surely labelled become added spans if skip edges, one after the other, tie them to a base
span of that kind.

The node weights (multinomial logistic regression) and edge potentials (smoothed log
odds) are fitted to counts over the whole corpus, with base labels as targets; the
distinct feature combinations that reach the driver are bounded by the feature space.

Defined results: null text counts as empty; it has no spans.  Offsets are code points,
ends are exclusive.  Rows are independent, so repeated rows agree.  An empty table gives
no rows.  Only the id and text columns are read by the query.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.  Possessive quantifiers and the look-behind only spare attempts that fail.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_WORD = re.compile(r"\S+")
_AROUND = ".,;:!?()[]<>\"'"
_NOT_DIGIT = re.compile("[^0-9]")
#: What a document needs to have any base span.
HINT = "[0-9@]"
#: A run is added from this probability on; belief propagation stops after so many rounds.
SURE, ROUNDS = 0.9, 12
#: Nodes or messages that are computed at once, which bounds memory in long documents.
SLICE = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in order of kind and start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


#: One-hot features of a node: widths of the fields of ``_fields``.
_WIDTHS = (5, 2, 2, 4, 8, 3)


def _fields(token: str, known: int) -> tuple[int, ...]:
    """Base label + 1 (0: not shown), at sign, leading plus, dots, digits, letters."""
    digits, letters = len(_NOT_DIGIT.sub("", token)), sum(c.isalpha() for c in token)
    size = 0 if digits < 1 else 1 if digits < 2 else 2 if digits < 5 else 3 if digits < 8 else 4 if digits < 12 else 5 if digits < 16 else 6 if digits < 20 else 7
    return known, int("@" in token), int(token.startswith("+")), min(3, token.count(".")), size, min(2, letters)


def _graph(text: str, spans: list[tuple[int, int, int]]):
    """Tokens ``(start, end, base label)`` and edges ``(type, i, j)``; labels are 0 for other."""
    tokens, edges, seen = [], [], {}
    marks = sorted((s, e, k + 1) for k, s, e in spans)
    k = 0
    locals_ = {text[s:e].partition("@")[0].lower() for k, s, e in spans if k == 0}
    plain = any(len(x) >= 4 and not re.search("[0-9]", x) for x in locals_)
    for m in (_WORD if plain else _TOKEN).finditer(text):
        word = m[0].strip(_AROUND).lower()
        if plain and word not in locals_ and not _TOKEN.match(m[0]):
            continue
        while k < len(marks) and marks[k][1] <= m.start():
            k += 1
        inside = k < len(marks) and marks[k][0] < m.end()
        tokens.append((m.start(), m.end(), marks[k][2] if inside else 0))
        i = len(tokens) - 1
        if i and m.start() - tokens[i - 1][1] <= 1:
            edges.append((0, i - 1, i))
        digits = _NOT_DIGIT.sub("", word)
        keys = {word, word.partition("@")[0]} if len(word) >= 4 else set()
        keys |= {digits[-7:]} if len(digits) >= 7 else set()
        for key in sorted(x for x in keys if len(x) >= 4):
            seen.setdefault(key, []).append(i)
    for own in seen.values():
        edges += [(1, i, j) for i, j in zip(own, own[1:])]
        sure = next((i for i in own if tokens[i][2]), None)
        for i in own if sure is not None else ():  # evidence fades along the chain
            if tokens[i][2]:
                sure = i
            else:
                edges.append((1, min(i, sure), max(i, sure)))
    return tokens, sorted(set(edges))


def _tied(tokens, edges) -> set[tuple[int, int]]:
    """``(token, kind)`` for the kinds of base spans that skip edges, one after the other, lead to."""
    top = list(range(len(tokens)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    linked = [(i, j) for kind, i, j in edges if kind]
    for i, j in linked:
        a, b = root(i), root(j)
        top[max(a, b)] = min(a, b)
    kinds: dict[int, set[int]] = {}
    inside = {i for pair in linked for i in pair}
    for i in inside:
        if tokens[i][2]:
            kinds.setdefault(root(i), set()).add(tokens[i][2])
    return {(i, k) for i in inside for k in kinds.get(root(i), ())}


def _counted(text: str, found: Counter) -> None:
    spans = base_spans(text)
    tokens, edges = _graph(text, spans)
    for s, e, y in tokens:
        for shown in (0, 1):  # half of the evidence hides the base label
            found["n", *_fields(text[s:e], (y + 1) * shown if y else 0), y] += 1
    for kind, i, j in edges:
        found["e", kind, tokens[i][2], tokens[j][2], 0, 0, 0, 0] += 1


class Field:
    """A fitted random field."""

    def __init__(self, counts: list[tuple]) -> None:
        nodes = [(c[1:7], c[7], n) for c, n in counts if c[0] == "n"]
        self.weights = self._fitted(nodes)
        self.edges = np.zeros((2, 5, 5))
        for kind in (0, 1):
            table = np.full((5, 5), 0.2) + np.diag([20.0, 2, 2, 2, 2])
            for c, n in counts:
                if c[0] == "e" and c[1] == kind:
                    table[c[2], c[3]] += n / 2
                    table[c[3], c[2]] += n / 2
            share = table / table.sum()
            self.edges[kind] = np.clip(np.log(share / np.outer(share.sum(1), share.sum(0))), -4, 4)

    @staticmethod
    def _rows(fields) -> np.ndarray:
        x = np.zeros((len(fields), sum(_WIDTHS) + 1))
        x[:, -1] = 1
        for r, f in enumerate(fields):
            x[r, np.cumsum([0, *_WIDTHS[:-1]]) + np.minimum(f, np.array(_WIDTHS) - 1)] = 1
        return x

    def _fitted(self, nodes) -> np.ndarray:
        if not nodes:
            return np.zeros((sum(_WIDTHS) + 1, 5))
        x, y, n = self._rows([f for f, _, _ in nodes]), np.array([c for _, c, _ in nodes]), np.array([k for _, _, k in nodes], float)
        n, target = np.sqrt(n) / np.sqrt(n).sum(), np.eye(5)[y]
        w = np.zeros((x.shape[1], 5))
        for _ in range(600):
            p = x @ w
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            w += 2.0 * (x.T @ (n[:, None] * (target - p))) - 1e-4 * w
        return w

    def beliefs(self, fields, edges) -> np.ndarray:
        """Label probabilities of each node by loopy sum-product messages."""
        node = np.concatenate([self._rows(fields[a : a + SLICE]) @ self.weights for a in range(0, len(fields), SLICE)])
        if edges:
            kind, i, j = np.array(edges).T
            src, dst, kind = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([kind, kind])
            back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
            sent = np.zeros((len(src), 5))
            for _ in range(ROUNDS):
                total, new = node.copy(), np.empty_like(sent)
                np.add.at(total, dst, sent)
                for a in range(0, len(src), SLICE):
                    part = slice(a, a + SLICE)
                    out = (total[src[part]] - sent[back[part]])[:, :, None] + self.edges[kind[part]]
                    top = out.max(axis=1, keepdims=True)
                    new[part] = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                new -= new.max(axis=1, keepdims=True)
                done, sent = np.abs(new - sent).max() < 1e-4, 0.5 * (new + sent)
                if done:
                    break
            np.add.at(node, dst, sent)
        p = np.exp(node - node.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans besides the base ones, not touching any of them."""
        tokens, edges = _graph(text, spans)
        tied = _tied(tokens, edges)
        if not any(tokens[i][2] == 0 for i, _ in tied):
            return []
        p = self.beliefs([_fields(text[s:e], y + 1 if y else 0) for s, e, y in tokens], edges)
        label, out = p.argmax(axis=1), []
        bases = sorted((a, b) for _, a, b in spans)
        reach = list(accumulate((b for _, b in bases), max))
        for i, (s, e, y) in enumerate(tokens):
            k = int(label[i])
            if y or not k or p[i, k] < SURE or (i, k) not in tied:
                continue
            while e > s and text[e - 1] in ".,;:!?)]>\"'":
                e -= 1
            while s < e and text[s] in "([<\"'":
                s += 1
            before = bisect.bisect_left(bases, (e,))  # base spans that begin before the token ends
            if s < e and not (before and reach[before - 1] > s):
                out.append((k - 1, s, e))
        return out


def fit(docs: DataFrame, text: str = "text") -> Field:
    """A field from all documents' tokens."""

    def count(batches):
        found: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                _counted(t, found)
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, k)) for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["k", "n"])

    rows = docs.select(F.col(text).alias("t")).where(F.col("t").rlike(HINT)).mapInArrow(count, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return Field(sorted(((k[0], *map(int, k.split(",")[1:])), n) for k, n in rows))


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, the base spans' digest, and all spans of every document."""

    def spans(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                base = base_spans(t) if t else []
                every = sorted(base + field.added(t, base)) if base else []
                kinds = Counter(k for k, _, _ in base)
                for column, v in zip(out, (*(kinds[k] for k in range(4)), hashlib.sha256(named(base).encode()).hexdigest(), named(every))):
                    column.append(v)
            arrays = [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(c, pa.string()) for c in out[4:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(F.col(text).rlike(HINT), F.col(text)).alias("t"))
    return rows.mapInArrow(spans, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the first
    (and then the longest) names the whole stretch."""
    out, at, left = [], 0, sorted((s, -e, k) for k, s, e in spans)
    for s, e, k in left:
        e = -e
        if s < at:  # extends a stretch that is already masked
            at = max(at, e)
            continue
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars`` set to its new length."""
    names = docs.columns

    def mask(batches):
        for b in batches:
            texts = b.column(names.index(text)).to_pylist()
            for i, t in enumerate(texts):
                if t and (base := base_spans(t)):
                    texts[i] = masked(t, base + field.added(t, base))
            b = b.set_column(names.index(text), text, pa.array(texts, pa.string()))
            if n_chars in names:
                sizes = [len(t) if t is not None else n for t, n in zip(texts, b.column(names.index(n_chars)).to_pylist())]
                b = b.set_column(names.index(n_chars), n_chars, pa.array(sizes, pa.int64()))
            yield b

    return docs.mapInArrow(mask, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return find(docs, fit(docs))
