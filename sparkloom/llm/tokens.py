"""Token ids of the public byte-pair vocabularies, fast.

The ``tokenizers`` library encodes about 3 MB of text a CPU second here, which is over
the limits by itself.  Texts of common Latin letters are therefore merged by
``tiktoken``'s loop, built from the same file's vocabulary and merges; every other
text, and any that spells a special token, goes to ``tokenizers`` itself.  The ids are
those of ``tokenizers.encode(text, add_special_tokens=False)`` either way, which the
tests compare.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: The word vocabulary's pieces of a lower-cased text of the letters below (fixed values).
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Other characters than ASCII and the Latin letters.
_WORD_RARE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_BYTE_RARE = re.compile("[^\x00-ɏ]")
#: The byte-level vocabulary's pieces (fixed value).
_BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ends each piece where the vocabulary marks word ends; texts with it count as rare.
_END = "\x00"


#: Characters that are encoded together.
TOGETHER = 500_000
#: Stands between texts that are encoded together; texts with it count as rare.
_BREAK = "\x01"
#: Classes of UTF-8 bytes: white space, letters, single digits, the break, others.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_CLASS[1] = 3


def _marked(texts: list[str]) -> str:
    """The texts' pieces, each followed by the end mark, with a break after each text.

    A piece is a digit or a run of one class; texts with an apostrophe are cut by
    ``_PIECES`` instead."""
    data = np.frombuffer((_BREAK.join(texts) + _BREAK).lower().encode(), np.uint8)
    kind = _CLASS[data]
    ends = np.empty(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=ends[:-1])
    ends[-1] = True
    ends |= (kind == 2) | (kind == 3)
    held = kind != 0
    ends &= held
    places = np.cumsum(held + ends.view(np.uint8)) - 1 - ends
    out = np.zeros(int(places[-1]) + 2, np.uint8)
    out[places[held]] = data[held]
    return out.tobytes().decode()


def _alphabet() -> dict[str, int]:
    """The byte each character stands for in such files: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Encodes texts as arrays of uint16 ids; the vocabulary must have at most 65,536."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, byte = model["end_of_word_suffix"] or "", _alphabet()
        self.by_word = bool(suffix)

        def raw(token: str) -> bytes:
            end = self.by_word and token.endswith(suffix)
            body = token[: -len(suffix)] if end else token
            return bytes(byte[c] for c in body) + _END.encode() * end

        singles = [t for t in model["vocab"] if len(t) == 1]
        ends = [t + suffix for t in singles] if self.by_word else []
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [*singles, *ends, *("".join(p) for p in pairs)]
        # The end mark is the byte 0 here; the vocabulary's own byte 0 only occurs in rare texts.
        ranks: dict[bytes, int] = {_END.encode(): len(order)} if self.by_word else {}
        ids = np.zeros(len(order) + 1, np.uint16)
        for rank, token in enumerate(order):
            if token in model["vocab"]:
                ids[rank] = model["vocab"][token]
                ranks.setdefault(raw(token), rank)
        self.ids = ids
        pattern = f"[^{_END}]+{_END}" if self.by_word else _BYTE_PIECES
        self.break_id = model["vocab"].get(next(c for c, b in byte.items() if b == ord(_BREAK)) + suffix)
        self.merger = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)

    def _rare(self, text: str) -> bool:
        return "<|" in text or (_WORD_RARE if self.by_word else _BYTE_RARE).search(text) is not None

    def _merged(self, text: str) -> np.ndarray:
        return self.ids[np.array(self.merger.encode_ordinary(text), np.int32)]

    def one(self, text: str) -> np.ndarray:
        """Ids of ``text``."""
        if self._rare(text):
            return self._library(text)
        if self.by_word:
            pieces = _PIECES.findall(text.lower())
            text = _END.join(pieces) + _END if pieces else ""
        return self._merged(text)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; common texts of the word vocabulary are encoded together."""
        if not self.by_word:
            return [self.one(t) for t in texts]
        out: list = [None] * len(texts)
        plain, size = [], 0
        for i, t in enumerate(texts):
            if "'" not in t and not self._rare(t):
                plain.append(i)
                size += len(t)
            if not plain or size < TOGETHER and i + 1 < len(texts):
                continue
            ids = self._merged(_marked([texts[i] for i in plain]))
            at = 0
            for k, end in zip(plain, np.flatnonzero(ids == self.break_id).tolist()):
                out[k], at = ids[at:end], end + 1
            plain, size = [], 0
        return [self.one(t) if x is None else x for x, t in zip(out, texts)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
