"""Vectorised word handling over the UTF-8 bytes of Arrow string columns.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; no word crosses
a document. Any range of bytes is hashed from two prefix sums modulo a prime (``RangeHash``), ranges that do not overlap from
sums of random values (``PlaceHash``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


P61 = np.uint64((1 << 61) - 1)
_30, _31, _32, _61 = (np.uint64(k) for k in (30, 31, 32, 61))
_BLOCK = 1 << 14
_M30, _M31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo 2**61 - 1."""
    x = (x & P61) + (x >> _61)
    return np.where(x >= P61, x - P61, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of values below it, from halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> _31, a & _M31, b >> _31, b & _M31
    mid = a1 * b0 + a0 * b1
    return _fold(((a1 * b1) << np.uint64(1)) + (mid >> _30) + ((mid & _M30) << _31) + a0 * b0)


class RangeHash:
    """Hashes of any ranges of bytes (or of 64-bit symbols): polynomials modulo the prime 2**61 - 1 at a random place.

    Two different ranges of n values have one hash with a probability of n / 2**61; each instance is independent.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 59, (1 << 61) - 1))
        self.shift = np.uint64(rng.integers(1 << 20, 1 << 21))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            m = 1 << max(16, int(n).bit_length())
            self.up, self.down = self._powers(self.base, m), self._powers(pow(self.base, -1, int(P61)), m)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, _times(out, np.uint64(pow(base, len(out), int(P61))))])
        return out

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums over bytes, or over 64-bit symbols (modulo the prime)."""
        self._grow(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        for at in range(0, len(values), _BLOCK):  # arrays that stay in the processor's cache
            v = values[at : at + _BLOCK]
            up = self.up[at : at + len(v)]
            if v.dtype == np.uint8:
                v = v.astype(np.uint64) + self.shift  # below 2**22
                high = v * (up >> _31)
                terms = (high >> _30) + ((high & _M30) << _31) + v * (up & _M31)
            else:
                terms = _times(_fold(v), up)
            sums = np.cumsum(terms)
            wraps = np.zeros(len(sums), np.uint64)
            np.cumsum(sums[1:] < sums[:-1], out=wraps[1:], dtype=np.uint64)
            out[at + 1 : at + 1 + len(v)] = _fold(_fold(sums) + (wraps << np.uint64(3)) + out[at])  # 2**64 is 8 modulo the prime
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64(_times(_fold(prefix[end] + (P61 - prefix[start])), self.down[start]))


class PlaceHash:
    """Hashes of ranges that do not overlap: sums, modulo 2**64, of a random value for each byte at each place in its range."""

    def __init__(self, seed: int):
        self.seed = np.uint64(np.random.default_rng(seed).integers(1 << 62))
        self.near = self.value(np.arange(64 * 256, dtype=np.uint64))

    def value(self, place_and_byte: np.ndarray) -> np.ndarray:
        return mix64(mix64(place_and_byte + self.seed) + self.seed)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each range; the ranges ascend."""
        out = np.zeros(len(start), np.uint64)
        cut = np.unique(np.append(np.searchsorted(start, np.arange(0, len(data), _BLOCK)), len(start)))
        for i, j in zip(cut, cut[1:], strict=False):
            out[i:j] = self._some(data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i])
        return out

    def _some(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        first = np.repeat(start, np.diff(np.append(start, len(data))))  # where the range of each byte begins
        place = ((np.arange(len(data)) - first) << 8) | data
        far = np.flatnonzero(place >= len(self.near)) if len(data) > 64 else []
        values = self.near[np.minimum(place, len(self.near) - 1)] if len(far) else self.near[place]
        if len(far):
            values[far] = self.value(place[far].astype(np.uint64))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        return mix64(sums[end] - sums[start])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text each (one row at least), with their bytes and offsets."""
    for batch in batches:
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
        ends = np.cumsum(np.asarray(pc.binary_length(column)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at), *column_bytes(column.slice(at, to - at))
            at = to


class Words:
    """Places of the words of consecutive documents."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        if len(data):
            word = ~SPACE[data]
            first = np.zeros(len(data) + 1, bool)
            first[offs] = True
            before = np.concatenate([[False], word[:-1]]) & ~first[:-1]
            after = np.concatenate([word[1:], [False]]) & ~first[1:]
            self.start = np.flatnonzero(word & ~before)
            self.end = np.flatnonzero(word & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: Word index at which each document begins, and the number of all words at the end.
        self.doc = np.searchsorted(self.start, offs)
        self.doc[-1] = len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts())

    def joined(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with one space between the words of a document, and the places of the words in them."""
        keep = np.zeros(len(self.data), bool)
        if len(self.data):
            keep = ~SPACE[self.data]
            inner = np.ones(len(self.start), bool)
            inner[self.doc[:-1][self.counts() > 0]] = False
            keep[self.start[inner] - 1] = True
        at = np.cumsum(keep)
        out = self.data[keep]
        out = np.where(SPACE[out], np.uint8(32), LOWER[out] if lower else out)
        return out, at[self.start] - 1, at[self.end - 1]


def sums_by(counts: np.ndarray, values: np.ndarray, dtype: type | None = None) -> np.ndarray:
    """Sums of consecutive groups of rows, with empty groups as zero."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype or values.dtype)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0, dtype=out.dtype)
    return out


_LANE = np.uint64(0x0001000100010001)


def bit_counts(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many values of each consecutive group have each of their 64 bits set."""
    most = int(counts.max()) if len(counts) else 0
    if most > 65_535:  # a lane counts so many: long groups are summed in parts
        parts = -(-np.maximum(counts, 1) // 65_535)
        each = np.full(int(parts.sum()), 65_535)
        each[np.cumsum(parts) - 1] = counts - (parts - 1) * 65_535
        return sums_by(parts, bit_counts(h, each))
    out = np.zeros((len(counts), 64), np.int64)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):  # arrays that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BLOCK, "right")))
        own = h[ends[at] - counts[at] : ends[to - 1]]
        full = counts[at:to] > 0
        first = (np.cumsum(counts[at:to]) - counts[at:to])[full]
        for k in range(16 if full.any() else 0):  # the bits k, k + 16, k + 32 and k + 48 at once, in lanes of 16 bits
            sums = np.add.reduceat((own >> np.uint64(k)) & _LANE, first)
            out[at:to, k::16][full] = sums.astype("<u8").view("<u2").reshape(-1, 4)
        at = to
    return out


class KeyTable:
    """Numbers 64-bit keys in the order in which they are first met; open addressing on whole arrays."""

    def __init__(self, bits: int = 18):
        self.count = 0
        self._reset(bits)

    def _reset(self, bits: int) -> None:
        self.bits = bits
        self.key = np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that are not in the table."""
        mask = (1 << self.bits) - 1
        slot = self._slot(keys)
        out = self.number[slot]
        todo = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        at = slot[todo]
        while len(todo):
            at = (at + 1) & mask
            got = self.number[at]
            out[todo] = got
            open_ = (got >= 0) & (self.key[at] != keys[todo])
            todo, at = todo[open_], at[open_]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that are not in the table."""
        if 2 * (self.count + len(keys)) > 1 << self.bits:
            full = self.number >= 0
            old, numbers = self.key[full], self.number[full]
            self._reset(max(self.bits + 1, int(2 * (self.count + len(keys))).bit_length() + 1))
            self._place(old, numbers)
        self._place(keys, np.arange(self.count, self.count + len(keys), dtype=np.int32))
        self.count += len(keys)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.number[slot] < 0)
            self.number[slot[free]] = numbers[free]
            self.key[slot[free]] = keys[free]
            lost = self.number[slot] != numbers
            keys, numbers, slot = keys[lost], numbers[lost], (slot[lost] + 1) & mask
