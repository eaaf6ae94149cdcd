"""Removal of long repeats of words by recompression.

Words are symbols. In each round, runs of one symbol and then pairs of a left and a right symbol (each
symbol's side is a bit of its name in that round) become new symbols. The name of a new symbol is a hash of what
it is made of, so all executors name equal runs and pairs alike without a dictionary, and equal stretches of text get
equal symbols in their interior: for each symbol the stretch of words that decides it is tracked exactly, across
neighbours that were looked at.

A window of words takes as its anchor, among the high-level symbols that are decided within it, the one with the
smallest name, and its own hash where there is none; equal windows thus have equal anchors. Rounds of questions then
find (1) which anchors occur at two places and (2), for windows with such anchors only, which windows (93 bits of
hash, polynomials modulo a prime at two random places) occur at two places. Words covered by these go.

Null texts have no words; texts shorter than a window lose nothing; repeated rows repeat all their windows; ties do
not arise, as every occurrence goes; null ids stay null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runs import MESSAGE, NO_ID, Documents, Exchange, bits, by_bucket, message, shared
from .textblocks import KeyTable, PlaceHash, RangeHash, Words, mix64

LEVELS = 4
_WORD, _WINDOW, _MORE = PlaceHash(41), RangeHash(43), RangeHash(47)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _name(*parts: np.ndarray | np.uint64) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = mix64((out ^ p) + _STEP)
    return out


class Parse:
    """Symbols of consecutive documents after some rounds: names and the words that decide each (``lo`` to ``hi``)."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, levels: int = LEVELS):
        """``doc``: the first word of each document and the number of all words."""
        counts = np.diff(doc)
        self.name, self.owner = words, np.repeat(np.arange(len(counts)), counts)
        self.lo = np.arange(len(words))
        self.hi = self.lo.copy()
        self.doc = doc
        for level in range(levels):
            self._runs(level)
            self._pairs(level)

    def _edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What lies beside each symbol: whether it begins or ends a document, and the words that decide its neighbours."""
        new = np.ones(len(self.name) + 1, bool)
        new[1:-1] = self.owner[1:] != self.owner[:-1]
        first, last = new[:-1], new[1:]
        left = np.where(first, self.doc[self.owner] - 1, np.concatenate([[0], self.lo[:-1]]))
        right = np.where(last, self.doc[self.owner + 1], np.concatenate([self.hi[1:], [0]]))
        return first, last, left, right

    def _runs(self, level: int) -> None:
        if not len(self.name):
            return
        first, last, left, right = self._edges()
        head = first.copy()
        head[1:] |= self.name[1:] != self.name[:-1]
        at = np.flatnonzero(head)
        end = np.append(at[1:], len(head)) - 1
        size = (end - at + 1).astype(np.uint64)
        one = size == 1
        run = _name(np.uint64(2 * level + 1), self.name[at], size)
        self.lo, self.hi = left[at], right[end]  # both neighbours were looked at
        self.name, self.owner = np.where(one, self.name[at], run), self.owner[at]

    def _pairs(self, level: int) -> None:
        if not len(self.name):
            return
        first, last, left, right = self._edges()
        is_left = (_name(np.uint64(level + 1000), self.name) & np.uint64(1)).astype(bool)
        opens = np.zeros(len(self.name), bool)
        opens[:-1] = is_left[:-1] & ~is_left[1:] & ~last[:-1]
        closes = np.concatenate([[False], opens[:-1]])
        lo = np.where(is_left | closes, self.lo, left)  # an unpaired right symbol looked at its left neighbour
        hi = np.where(~is_left | opens, self.hi, right)
        keep = ~closes
        at = np.flatnonzero(keep)
        joined = opens[at]
        second = at + joined
        self.lo, self.hi = lo[at], hi[second]
        self.name = np.where(joined, _name(np.uint64(2 * level + 2), self.name[at], self.name[second]), self.name[at])
        self.owner = self.owner[at]

    def anchors(self, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The smallest name decided within each window, and whether there is any."""
        if not len(self.name):
            return np.zeros(len(start), np.uint64), np.zeros(len(start), bool)
        words = int(self.doc[-1])
        before = np.concatenate([[0], np.cumsum(np.bincount(np.maximum(self.lo, -1) + 1, minlength=words + 2))])
        a = before[start + 1]  # symbols with lo < start
        until = np.concatenate([[0], np.cumsum(np.bincount(np.minimum(self.hi, words), minlength=words + 1))])
        b = until[start + window]  # symbols with hi < start + window
        some = b > a
        level = np.zeros(len(start), np.int64)
        span = (b - a)[some]
        level[some] = np.log2(span).astype(np.int64)
        out, lows, k = np.zeros(len(start), np.uint64), self.name, 0
        while True:
            own = np.flatnonzero(some & (level == k))
            out[own] = np.minimum(lows[a[own]], lows[b[own] - (1 << k)])
            if not (level > k).any():
                return out, some
            lows = np.minimum(lows[: -(1 << k)], lows[1 << k :]) if len(lows) > 1 << k else lows
            k += 1


class _Windows:
    def __init__(self, docs: Documents, window: int):
        self.words = Words(docs.data, docs.offs)
        symbols = _WORD.of(docs.data, self.words.start, self.words.end)
        counts = np.maximum(self.words.counts() - window + 1, 0)
        self.start = np.repeat(self.words.doc[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        self.hash = _WINDOW.ranges(_WINDOW.prefix(symbols), self.start, self.start + window)
        parse = Parse(symbols, self.words.doc)
        anchor, some = parse.anchors(self.start, window)
        self.anchor = np.where(some, anchor, _name(np.uint64(7), self.hash))
        # Where a name stands at several places of this run, it is shared already.
        self.names = np.concatenate([parse.name, self.anchor[~some]])
        self.symbols = symbols

    def asked_anchors(self) -> tuple[np.ndarray, np.ndarray]:
        changed = np.concatenate([[True], self.anchor[1:] != self.anchor[:-1]]) if len(self.anchor) else np.zeros(0, bool)
        keys = np.unique(self.anchor[changed])
        table = KeyTable()
        table.add(keys)
        at = table.find(self.names)
        return keys, np.minimum(np.bincount(at[at >= 0], minlength=len(keys)), 2).astype(np.uint8)

    def asked_windows(self, anchor_shared: np.ndarray, anchor_keys: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """Places of the windows with shared anchors, their numbers among the distinct ones, and those with counts."""
        table = KeyTable()
        table.add(anchor_keys)
        own = np.flatnonzero(anchor_shared[table.find(self.anchor)]) if len(self.anchor) else np.zeros(0, np.int64)
        more = _MORE.ranges(_MORE.prefix(self.symbols), self.start[own], self.start[own] + window).astype(np.uint32)
        h = self.hash[own]
        order = np.lexsort((more, h))
        h, m = h[order], more[order]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (m[1:] != m[:-1])]) if len(h) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        number = np.empty(len(own), np.int64)
        number[order] = group
        return own, number, h[first], m[first], np.minimum(np.bincount(group), 2).astype(np.uint8) if len(h) else np.zeros(0, np.uint8)


def dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` for every row; ``kept`` are the words that stay, joined by spaces."""
    ex = Exchange(docs, "recompress", id_col, text_col)
    n = ex.buckets

    def ask_anchors(run: int, own: Documents, _: list) -> Iterator[pa.RecordBatch]:
        keys, count = _Windows(own, window).asked_anchors()
        order, parts = by_bucket(keys, n)
        if parts:
            yield message(run, parts, keys[order], count[order])

    anchors = ex.answered(ex.passed(ask_anchors, MESSAGE, []), shared, "anchors")

    def second(own: Documents, got: list[bytes]) -> tuple:
        w = _Windows(own, window)
        keys, _ = w.asked_anchors()
        order, parts = by_bucket(keys, n)
        place, number, h, more, count = w.asked_windows(bits(got, [b - a for _, a, b in parts]), keys[order], window)
        order, parts = by_bucket(h, n)
        return w, place, number, h[order], more[order], count[order], order, parts

    def ask_windows(run: int, own: Documents, got: list) -> Iterator[pa.RecordBatch]:
        _, _, _, h, more, count, _, parts = second(own, got[0])
        if parts:
            yield message(run, parts, h, count, more)

    repeats = ex.answered(ex.passed(ask_windows, MESSAGE, [anchors]), shared, "windows")

    def remove(_: int, own: Documents, got: list) -> Iterator[pa.RecordBatch]:
        w, place, number, h, _, _, order, parts = second(own, got[0])
        twice = np.zeros(len(h), bool)
        twice[order] = bits(got[1], [b - a for _, a, b in parts])
        start = w.start[place[twice[number]]]
        total = len(w.words.start)
        cover = np.cumsum(np.bincount(start, minlength=total + 1)[: total + 1] - np.bincount(start + window, minlength=total + 1)[: total + 1])[:total]
        kept = cover == 0
        text, kept_text, digest, removed = own.data.tobytes(), [], [], []
        for d in range(len(own.ids)):
            a, b = w.words.doc[d], w.words.doc[d + 1]
            mine = np.flatnonzero(kept[a:b]) + a
            joined = b" ".join([text[s:e] for s, e in zip(w.words.start[mine].tolist(), w.words.end[mine].tolist(), strict=True)])
            kept_text.append(joined)
            digest.append(hashlib.sha256(joined).hexdigest())
            removed.append(int(b - a) - len(mine))
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.ids, mask=own.ids == NO_ID), pa.array(w.words.counts().astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )

    return ex.passed(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", [anchors, repeats])
