"""Removal of repeated byte strings by suffix order.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (a smaller document id, or the same document
further left). Each such window takes as its anchor the k-mer with the smallest hash in it, so equal windows have equal
anchors at equal places; the windows of one anchor occurrence are one context. Two rounds of questions decide:

1. Contexts are named by hash under their anchor. Where all contexts of an anchor are equal, every one but the first
   repeats it; later copies of any context repeat its first. Only first contexts of anchors with several different
   contexts (the edges of repeats) remain. Copies of a context meet in a bucket of the (anchor, context), so a frequent
   anchor is spread by its contexts; of an anchor itself each run sends its smallest and largest context and their number.
2. Those are sent to the buckets of their anchors, which sort the suffixes of the contexts (ranks of 8, 16, 32, 64, ...
   bytes, each from two of the half) and find for each window whether its rank was met earlier. Anchors with more than
   ``HOT`` contexts (counted by run) are not gathered: their windows are asked for one by one (93 bits of hash).

A context's name is 61 bits of hash over all its bytes; k-mers only bring together what may be equal.

Null texts count as empty and texts shorter than a window lose nothing; null ids come before others; rows with equal ids
are ordered by their place in the table's files; repeated rows repeat all but the first; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .lattice_lm import unpack
from .runs import MESSAGE, NO_ID, Documents, Exchange, by_bucket, message
from .textblocks import RangeHash, mix64

K, HOT, PART = 24, 20_000, 1 << 19
_CONTEXT, _MORE = RangeHash(59), RangeHash(61)
_SPREAD = np.random.default_rng(53).integers(0, 1 << 64, 3, dtype=np.uint64) | np.uint64(1)
FIRST, LATER, EDGE, CROWD = 0, 1, 2, 3


class Anchors:
    """Anchor occurrences of a run in text order: first and last window start, k-mer, context name, document."""

    def __init__(self, docs: Documents, length: int):
        self.docs, self.length = docs, length
        parts = []
        at, docs_n = 0, len(docs.ids)
        while at < docs_n:
            to = max(at + 1, int(np.searchsorted(docs.offs, docs.offs[at] + PART, "right")) - 1)
            parts.append(self._part(at, min(to, docs_n)))
            at = min(to, docs_n)
        self.s1, self.s2, self.kmer, self.context, self.doc = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(5))
        if not parts:
            self.kmer = self.context = np.zeros(0, np.uint64)
        # Rank of each occurrence by document id, then place.
        order = np.lexsort((self.s1, docs.ids[self.doc])) if len(self.s1) else np.zeros(0, np.int64)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        # The distinct (k-mer, context) pairs with their first occurrence.
        order = np.lexsort((self.rank, self.context, self.kmer))
        new = np.ones(len(order), bool)
        new[1:] = (self.kmer[order][1:] != self.kmer[order][:-1]) | (self.context[order][1:] != self.context[order][:-1])
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        self.first = order[new]

    def _part(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        base, data = self.docs.offs[a], self.docs.data[self.docs.offs[a] : self.docs.offs[b]]
        offs, n, width = self.docs.offs[a : b + 1] - base, self.length, self.length - K + 1
        count = np.maximum(np.diff(offs) - n + 1, 0)
        if not count.any():
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), none
        place = np.arange(len(data) - K + 1)
        eight = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
        hashed = sum(eight[8 * i : 8 * i + len(place)] * c for i, c in enumerate(_SPREAD))
        hashed = mix64(hashed ^ (hashed >> np.uint64(29)))
        key = (hashed & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
        # Smallest key of each stretch of ``width``: from suffix and prefix minima of blocks.
        blocks = -(-len(key) // width)
        padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        grid = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        start = np.repeat(offs[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = (np.minimum(behind[start], ahead[start + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        s1, s2, at = start[cut], start[np.append(cut[1:], len(start)) - 1], at[cut]
        context = _CONTEXT.ranges(_CONTEXT.prefix(data), s1, s2 + n)
        context = mix64(context ^ (at - s1).astype(np.uint64))
        doc = np.searchsorted(offs, s1, "right") - 1
        return s1 + base, s2 + base, hashed[at], context, doc + a


class _Contexts:
    """What a run asks in the first round: each (k-mer, context) of the bucket of the pair, whether it was met earlier, and each
    k-mer of its own bucket, whether it has one context everywhere. A k-mer is one entry of a run, however many contexts it has."""

    def __init__(self, own: Anchors, n: int):
        self.own = own
        kmer, self.context = own.kmer[own.first], own.context[own.first]
        # The pairs are in the order of k-mers, then contexts.
        head = np.flatnonzero(np.concatenate([[True], kmer[1:] != kmer[:-1]])) if len(kmer) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(head, len(kmer)))
        self.kmer, self.least, self.most = kmer[head], self.context[head], self.context[head + self.count - 1]
        self.pair_order, pairs = by_bucket(mix64(kmer ^ self.context), n)
        self.kmer_order, kmers = by_bucket(self.kmer, n)
        of_pairs, of_kmers = {b: (s, e) for b, s, e in pairs}, {b: (s, e) for b, s, e in kmers}
        #: bucket, pairs from and to, k-mers from and to
        self.parts = [(b, *of_pairs.get(b, (0, 0)), *of_kmers.get(b, (0, 0))) for b in sorted({*of_pairs, *of_kmers})]

    def messages(self, run: int) -> Iterator[pa.RecordBatch]:
        own, at = self.own, self.own.first[self.pair_order]
        kmer, context, doc = own.kmer[at], own.context[at], own.docs.ids[own.doc[at]]
        for b, s, e, ks, ke in self.parts:
            k = self.kmer_order[ks:ke]
            count = np.minimum(self.count[k], 1 << 31).astype(np.uint32)
            yield message(run, [(b, 0, max(e - s, ke - ks))], kmer[s:e], context[s:e], doc[s:e], self.kmer[k], self.least[k], self.most[k][count > 1], count)

    def state(self, answers: list[bytes]) -> np.ndarray:
        """Of each (k-mer, context): first, later, first at an edge, or first of a crowded anchor."""
        later, kind = np.zeros(len(self.context), bool), np.zeros(len(self.kmer), np.uint8)
        for (_, s, e, ks, ke), blob in zip(self.parts, answers, strict=True):
            got = unpack(blob)[0]
            later[self.pair_order[s:e]] = got[: e - s]
            kind[self.kmer_order[ks:ke]] = got[e - s :]
        return np.where(later, LATER, np.repeat(kind, self.count)).astype(np.uint8)


def _judge(hot: int, run_of: list[int], questions: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For each asked (k-mer, context, document) whether it is a later one; then for each k-mer, what its first contexts are."""
    n_pairs, n_kmers = [len(q[0]) for q in questions], [len(q[3]) for q in questions]
    kmer, context, doc, own, least, most, count = (np.concatenate([q[i] for q in questions]) for i in range(7))
    order = np.lexsort((np.repeat(np.array(run_of), n_pairs), doc, context, kmer))
    k, c = kmer[order], context[order]
    later = np.zeros(len(order), np.uint8)
    later[order[1:]] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    kind = np.zeros(len(own), np.uint8)
    if len(own):
        high = least.copy()
        high[count > 1] = most
        order = np.argsort(own, kind="stable")
        head = np.concatenate([[True], own[order][1:] != own[order][:-1]])
        at = np.flatnonzero(head)
        single = np.minimum.reduceat(least[order], at) == np.maximum.reduceat(high[order], at)
        contexts = np.add.reduceat(count[order].astype(np.int64), at)
        kind[order] = np.where(single, FIRST, np.where(contexts > hot, CROWD, EDGE))[np.cumsum(head) - 1]
    cut = lambda x, n: np.split(x, np.cumsum(n)[:-1])
    return [np.concatenate(x) for x in zip(cut(later, n_pairs), cut(kind, n_kmers), strict=True)]


def suffix_ranks(text: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows inside the strings (start, size), and their ranks in suffix order (equal windows alike)."""

    def places(n: int) -> np.ndarray:
        c = np.maximum(size - n + 1, 0)
        return np.repeat(start - (np.cumsum(c) - c), c) + np.arange(c.sum())

    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    step = 8
    at = places(step)
    words = np.ndarray((len(text),), ">u8", padded.tobytes(), strides=(1,))[at] if len(at) else np.zeros(0, np.uint64)
    rank = np.zeros(len(text) + 1, np.int64)
    rank[at] = np.unique(words.astype(np.uint64), return_inverse=True)[1]
    while step < length:
        wide = min(2 * step, length)
        at = places(wide)
        pair = (rank[at] << 32) | rank[at + wide - step]
        fresh = np.unique(pair, return_inverse=True)[1]
        rank = np.zeros(len(text) + 1, np.int64)
        rank[at] = fresh
        step = wide
    return at, rank[at]


def _edges(length: int, run_of: list[int], questions: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For every window of the contexts that were sent, whether it was met earlier; then the same for single windows."""
    n_ctx = [len(q[0]) for q in questions]
    group, doc, place, size, text = (np.concatenate([q[i] for q in questions]) for i in range(5))
    size = size.astype(np.int64)
    run = np.repeat(np.array(run_of), n_ctx)
    begin = np.cumsum(size) - size
    windows = size - length + 1
    into = np.cumsum(windows) - windows
    repeated = np.zeros(int(windows.sum()), bool)
    order = np.lexsort((place, run, doc, group))
    # About a megabyte of whole groups at a time.
    total = np.cumsum(size[order])
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")))
        while to < len(order) and group[order[to]] == group[order[to - 1]]:
            to += 1
        own = order[at:to]
        own = own[np.lexsort((place[own], run[own], doc[own]))]
        s = size[own]
        first = np.cumsum(s) - s
        mine = text[np.repeat(begin[own] - first, s) + np.arange(s.sum())]
        _, rank = suffix_ranks(mine, first, s, length)
        seen = np.full(int(rank.max()) + 1 if len(rank) else 0, len(rank))
        np.minimum.at(seen, rank, np.arange(len(rank)))
        w = windows[own]
        repeated[np.repeat(into[own] - (np.cumsum(w) - w), w) + np.arange(w.sum())] = seen[rank] < np.arange(len(rank))
        at = to
    cut = np.cumsum([int(w.sum()) for w in np.split(windows, np.cumsum(n_ctx)[:-1])])
    of_contexts = np.split(repeated, cut[:-1])
    n_win = [len(q[5]) for q in questions]
    h, more, doc, place = (np.concatenate([q[i] for q in questions]) for i in range(5, 9))
    order = np.lexsort((place, np.repeat(np.array(run_of), n_win), doc, more, h))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (h[order][1:] == h[order][:-1]) & (more[order][1:] == more[order][:-1])
    of_windows = np.split(later, np.cumsum(n_win)[:-1])
    return [np.packbits(np.concatenate([a, b])) for a, b in zip(of_contexts, of_windows, strict=True)]


class _Edge:
    """What a run asks in the second round, in bucket order."""

    def __init__(self, own: Anchors, state: np.ndarray, n: int):
        length, docs = own.length, own.docs
        self.later = np.ones(len(own.s1), bool)
        self.later[own.first] = state == LATER
        sent, crowd = own.first[state == EDGE], own.first[state == CROWD]
        order, ctx = by_bucket(own.kmer[sent], n)
        self.sent = sent[order]
        w = own.s2[crowd] - own.s1[crowd] + 1
        start = np.repeat(own.s1[crowd] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        h = np.zeros(len(start), np.uint64)
        more = np.zeros(len(start), np.uint32)
        if len(start):
            h = _CONTEXT.ranges(_CONTEXT.prefix(docs.data), start, start + length)
            more = _MORE.ranges(_MORE.prefix(docs.data), start, start + length).astype(np.uint32)
        order, win = by_bucket(h, n)
        self.start, self.h, self.more, self.doc = start[order], h[order], more[order], np.repeat(own.doc[crowd], w)[order]
        size = own.s2[self.sent] - own.s1[self.sent] + length
        of_ctx, of_win = {b: (s, e) for b, s, e in ctx}, {b: (s, e) for b, s, e in win}
        #: bucket, contexts from and to, windows from and to
        self.parts = [(b, *of_ctx.get(b, (0, 0)), *of_win.get(b, (0, 0))) for b in sorted({*of_ctx, *of_win})]
        self.windows = size - length + 1
        self.size, self.own = size, own

    def messages(self, run: int) -> Iterator[pa.RecordBatch]:
        own, docs = self.own, self.own.docs
        for b, s, e, ws, we in self.parts:
            a, size = self.sent[s:e], self.size[s:e]
            text = docs.data[np.repeat(own.s1[a] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            group = (own.kmer[a] >> np.uint64(32)).astype(np.uint32)
            yield message(
                run, [(b, 0, max(len(a), len(text), we - ws))], group, docs.ids[own.doc[a]], own.s1[a].astype(np.uint32), size.astype(np.uint32), text,
                self.h[ws:we], self.more[ws:we], docs.ids[self.doc[ws:we]], self.start[ws:we].astype(np.uint32),
            )

    def repeated(self, answers: list[bytes]) -> np.ndarray:
        """Starts of all windows that were met earlier, the local ones included."""
        own, out = self.own, []
        for (_, s, e, ws, we), blob in zip(self.parts, answers, strict=True):
            a, w = self.sent[s:e], self.windows[s:e]
            got = np.unpackbits(unpack(blob)[0], count=int(w.sum()) + we - ws).astype(bool)
            start = np.repeat(own.s1[a] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            out.append(np.concatenate([start, self.start[ws:we]])[got])
        w = np.where(self.later, own.s2 - own.s1 + 1, 0)
        out.append(np.repeat(own.s1 - (np.cumsum(w) - w), w) + np.arange(w.sum()))
        return np.concatenate(out)


def dedup(docs: DataFrame, length: int = 100, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row; ``kept`` are the bytes that stay."""
    ex = Exchange(docs, "suffix", id_col, text_col)
    n = ex.buckets

    def ask_contexts(run: int, d: Documents, _: list) -> Iterator[pa.RecordBatch]:
        yield from _Contexts(Anchors(d, length), n).messages(run)

    states = ex.answered(ex.passed(ask_contexts, MESSAGE, []), lambda runs, asked: _judge(hot, runs, asked), "states", runs=True)

    def edge(d: Documents, got: list[bytes]) -> _Edge:
        own = Anchors(d, length)
        return _Edge(own, _Contexts(own, n).state(got), n)

    def ask_edges(run: int, d: Documents, got: list) -> Iterator[pa.RecordBatch]:
        yield from edge(d, got[0]).messages(run)

    def sort_edges(runs: list[int], questions: list[list[np.ndarray]]) -> list[np.ndarray]:
        return _edges(length, runs, questions)

    met = ex.answered(ex.passed(ask_edges, MESSAGE, [states]), sort_edges, "met", runs=True)

    def remove(_: int, d: Documents, got: list) -> Iterator[pa.RecordBatch]:
        start = edge(d, got[0]).repeated(got[1])
        total = len(d.data)
        change = np.bincount(start, minlength=total + 1)[: total + 1] - np.bincount(start + length, minlength=total + 1)[: total + 1]
        gone = np.cumsum(change)[:total] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = d.offs[:-1][(d.offs[:-1] < total)]
        begins[inner] = gone[inner]
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[d.offs])
        stay = d.data[~gone]
        at = np.concatenate([[0], np.cumsum(~gone)])[d.offs]
        kept = [stay[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(d.ids, mask=d.ids == NO_ID), pa.array(np.diff(d.offs)), pa.array(sums(gone)), pa.array(sums(begins)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )

    return ex.passed(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", [states, met])
