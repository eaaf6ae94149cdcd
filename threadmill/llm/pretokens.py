"""Encoding whole texts with a byte-level BPE of the tokenizers library, each distinct pretoken once per worker.

Byte-level BPE never merges across the pretokens of its splitting rule, so the ids of a text are those of its
pretokens in order. The places of the pretokens are found for many texts at once with arrays; only pretokens that
this worker has not met are given to the library. Strings of special tokens inside texts are ordinary text.
Tokenizers of any other build are given the whole texts.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from .textblocks import KeyTable, PlaceHash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

KEPT = 4_000_000
_HASH = PlaceHash(23)
_KINDS: np.ndarray | None = None
_OPEN: dict[str, Encoder] = {}
#: The characters of the Unicode property White_Space.
_WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_S, _L, _N, _O = 0, 1, 2, 3


def kinds() -> np.ndarray:
    """White space, letter, number or other, for every code point."""
    global _KINDS
    if _KINDS is None:
        cats = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        k = np.full(0x110000, _O, np.uint8)
        k[np.array([c == "L" for c in cats])] = _L
        k[np.array([c == "N" for c in cats])] = _N
        k[list(_WHITE)] = _S
        _KINDS = k
    return _KINDS


def split(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte places at which pretokens of consecutive texts begin."""
    if not len(data):
        return np.zeros(0, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(len(cp) + 1, bool)
    first[np.searchsorted(place, offs)] = True
    kind = kinds()[cp]
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = cp == 0x20
    follows = np.zeros(len(cp), bool)  # the character after a plain space of the same text
    follows[1:] = blank[:-1] & ~first[1:-1]
    begin = run & ((kind == _S) | ~follows)
    # White space before a character of the same text: its last one begins a pretoken.
    before = run & (kind != _S) & ~first[:-1]
    at = np.flatnonzero(before)
    at = at[kind[at - 1] == _S] - 1
    begin[at] = True
    # An apostrophe that begins a pretoken and stands alone takes s, t, m, d, re, ve or ll with it.
    q = np.flatnonzero((cp == 0x27) & begin)
    q = q[(q + 1 < len(cp))]
    q = q[~first[q + 1] & (kind[np.minimum(q + 1, len(cp) - 1)] == _L)]
    if len(q):
        one = cp[q + 1]
        two = np.where((q + 2 < len(cp)) & ~first[np.minimum(q + 2, len(cp))], cp[np.minimum(q + 2, len(cp) - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(q), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        q, took = q[single | double], np.where(double, 2, 1)[single | double]
        begin[q + 1] = False
        rest = q + 1 + took
        rest = rest[rest < len(cp)]
        rest = rest[~first[rest] & (kind[rest] == _L)]
        begin[rest] = True
    return place[begin]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        rule = json.loads(self.tokenizer.to_str())
        pre = rule.get("pre_tokenizer") or {}
        self.by_pretoken = rule.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.size = self.tokenizer.get_vocab_size()
        self.begins = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token.startswith("\u0120")  # how the byte-level alphabet writes a space
        self._clear()

    def _clear(self) -> None:
        self.known = KeyTable()
        self.at, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Pretokens of a space and letters are given to the library many at a time: run together, each still is a
        pretoken, and its first id is one that begins with the space."""
        joint = np.array([t[:1] == " " and t[1:2].isalpha() for t in texts])
        order = np.concatenate([np.flatnonzero(joint), np.flatnonzero(~joint)])
        many = int(joint.sum())
        runs = ["".join([texts[i] for i in order[k : min(k + 500, many)]]) for k in range(0, many, 500)]
        ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.int32), *ids])
        first = np.flatnonzero(self.begins[ids])
        count = np.diff(np.append(first, len(ids)))
        got = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in order[many:]], add_special_tokens=False)]
        count = np.concatenate([count, np.fromiter(map(len, got), np.int64, len(got))])
        if len(count) != len(keys):
            raise ValueError("the tokenizer does not keep its pretokens apart")
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids, np.fromiter((i for g in got for i in g), np.int32)])
        self.known.add(keys[order])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        docs = len(offs) - 1
        if not self.by_pretoken:
            text = data.tobytes()
            got = self.tokenizer.encode_batch_fast([text[a:b].decode() for a, b in zip(offs, offs[1:], strict=False)], add_special_tokens=False)
            ids = [np.array(e.ids, np.int32) for e in got]
            return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)
        start = split(data, offs)
        end = np.append(start[1:], len(data))
        key = _HASH.of(data, start, end)
        if self.known.count > KEPT:
            self._clear()
        place = self.known.find(key)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = data.tobytes()
            keys, first = np.unique(key[new], return_index=True)
            spans = zip(start[new[first]].tolist(), end[new[first]].tolist(), strict=True)
            self._learn(keys, [raw[a:b].decode("utf-8", "replace") for a, b in spans])
            place[new] = self.known.find(key[new])
        count, at = self.count[place].astype(np.int64), self.at[place]
        into = np.cumsum(count) - count
        ids = self.ids[np.repeat(at - into, count) + np.arange(int(count.sum()))] if len(count) else np.zeros(0, np.int32)
        bounds = np.searchsorted(start, offs)
        bounds[-1] = len(start)
        total = np.append(into, len(ids))
        return ids, np.diff(total[bounds]) if docs else np.zeros(0, np.int64)


def encoder(path: str) -> Encoder:
    """The encoder of this process for a tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
