"""Encoding and decoding with a word-level BPE: speculate, verify, merge what fails.

For each distinct word of a slice the longest vocabulary entries from left to right are proposed. A proposal is what BPE gives if
every entry is what BPE makes of its own bytes and if no merge crosses from an entry to the next one. Both are decided for
all pairs at once with arrays (``Vocabulary.crossed``): going back in time, the last symbol of the left entry and the first of
the right one are undone, the later made of the two first, and at each step their merge must not be due while both exist. Words with a
failing pair are merged exactly, by rank and then by place.

Texts are normalised and split as the tokenizer file says: NFC, lower case, white space dropped, contractions, letters, single
numbers and other characters apart; strings of special tokens inside texts stand for these tokens. Texts that only hold characters
which NFC leaves alone are lower-cased by a table, the others by the library's own normaliser. Files of another build raise a ValueError.

Null texts are empty and have no ids; repeated rows are encoded repeatedly; null ids pass through; very long words
are merged in n log n; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import kinds
from .textblocks import KeyTable, PlaceHash, slices

NEVER = 1 << 40
KEPT = 4_000_000
_HASH = PlaceHash(31)
_WHITE, _LETTER, _NUMBER, _OTHER, _SPECIAL = range(5)
_TOP = 0x110000
#: The parts of a tokenizer file that this module reproduces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_LOWER: np.ndarray | None = None
_OPEN: dict[str, Encoder] = {}


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the byte-level alphabet stands for: printable Latin-1 characters stand for themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def lower_table() -> np.ndarray:
    """The lower-case code point of each code point, -1 where the whole text is to be normalised by the library."""
    global _LOWER
    if _LOWER is None:
        table = np.arange(_TOP, dtype=np.int32)
        for c in range(0x80, _TOP):
            if 0xAC00 <= c < 0xD7A4 or 0x3400 <= c < 0x4DC0 or 0x4E00 <= c < 0xA000 or 0xD800 <= c < 0xF900 or 0x20000 <= c < 0x2A6E0 or c >= 0xF0000:
                continue  # large blocks without case that NFC leaves alone
            ch = chr(c)
            low, cat = ch.lower(), unicodedata.category(ch)
            odd = cat[0] == "M" or cat == "Cn" or 0x1100 <= c < 0x1200 or len(low) != 1 or not unicodedata.is_normalized("NFC", ch)
            table[c] = -1 if odd else ord(low)
        table[65:91] += 32
        _LOWER = table
    return _LOWER


class Vocabulary:
    """Merges as arrays: rank and parts of each entry (rank -1: a single byte) and the rank of each pair."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        letters = byte_letters()
        size = max(vocab.values()) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        pair, twice = np.zeros(len(merges), np.int64), set()
        for m, (a, b) in enumerate(merges):
            made = vocab[a + b]
            if self.rank[made] >= 0:
                twice.add(made)
            else:
                self.rank[made], self.left[made], self.right[made] = m, vocab[a], vocab[b]
            pair[m] = (vocab[a] << 32) | vocab[b]
        self._pair_rank = np.argsort(pair, kind="stable")
        self._pair = pair[self._pair_rank]
        self.merge = {int(k): (m, vocab[a + b]) for m, (k, (a, b)) in enumerate(zip(pair, merges, strict=True))}
        #: Entries by their bytes: inside a word, and at its end.
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {} if suffix else self.inner
        for token, i in vocab.items():
            end = bool(suffix) and token.endswith(suffix)
            token = token[: -len(suffix)] if end else token
            if token and all(c in letters for c in token):
                (self.final if end else self.inner)[bytes(letters[c] for c in token)] = i
        self.reach: dict[bytes, int] = {}  # the longest inner entry that begins with these two bytes
        for token in self.inner:
            self.reach[token[:2]] = max(self.reach.get(token[:2], 1), len(token))
        self.longest = max(map(len, self.final), default=0)
        self.sound = self._sound(twice)

    def _sound(self, twice: set[int]) -> np.ndarray:
        """Entries that BPE makes of their own bytes, in the order of ranks that the check of pairs relies on."""
        made = np.flatnonzero(self.rank >= 0)
        a, b, m = self.left[made], self.right[made], self.rank[made]
        good = (self.rank[a] < m) & (self.rank[b] < m) & ~self.crossed(a, b, m)
        sound = np.ones(len(self.rank), bool)
        sound[made] = good
        sound[list(twice)] = False
        if not np.all(good):
            ranks = np.array([max(self.rank[k >> 32], self.rank[k & 0xFFFFFFFF]) for k in self._pair])
            if np.any(ranks >= self._pair_rank):
                sound[:] = False  # merges out of order: nothing can be said from pairs
        for t in made[np.argsort(m)]:
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        return sound

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self._pair):
            return np.full(len(a), NEVER)
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._pair, key), len(self._pair) - 1)
        return np.where(self._pair[at] == key, self._pair_rank[at], NEVER)

    def crossed(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge of the end of ``a`` with the beginning of ``b`` is due while both exist, before ``until``."""
        x, y, out, live = a.copy(), b.copy(), np.zeros(len(a), bool), np.arange(len(a))
        gone_x = np.full(len(a), NEVER) if until is None else until.copy()  # the rank at which x is merged to its left
        gone_y = gone_x.copy()
        while len(live):
            due = self.pair_rank(x[live], y[live])
            # Of equal ranks the merge further left comes first: that of x with its left neighbour, but this one before that of y.
            hit = (due < gone_x[live]) & (due <= gone_y[live]) & (due < NEVER)
            out[live[hit]] = True
            live = live[~hit]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            live, rx, ry = (v[(rx >= 0) | (ry >= 0)] for v in (live, rx, ry))
            on_left = rx > ry
            i, j = live[on_left], live[~on_left]
            gone_x[i], x[i] = rx[on_left], self.right[x[i]]
            gone_y[j], y[j] = ry[~on_left], self.left[y[j]]
        return out

    def proposed(self, word: bytes) -> list[int]:
        """The longest entries from left to right."""
        out, at, n = [], 0, len(word)
        while at < n:
            if n - at <= self.longest and (t := self.final.get(word[at:])) is not None:
                out.append(t)
                break
            for size in range(min(n - at - 1, self.reach.get(word[at : at + 2], 1)), 0, -1):
                if (t := self.inner.get(word[at : at + size])) is not None:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            out.append(t)
            at += size
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of the lowest rank first, of equal ones the leftmost."""
        own = [self.inner[word[i : i + 1]] for i in range(len(word) - 1)] + [self.final[word[-1:]]]
        after, before = list(range(1, len(own) + 1)), list(range(-1, len(own) - 1))
        heap = [(self.merge[k][0], i, k) for i in range(len(own) - 1) if (k := (own[i] << 32) | own[i + 1]) in self.merge]
        heapify(heap)
        while heap:
            _, i, k = heappop(heap)
            j = after[i]
            if own[i] < 0 or j >= len(own) or (own[i] << 32) | own[j] != k:
                continue
            own[i], own[j] = self.merge[k][1], -1
            after[i] = after[j]
            if after[j] < len(own):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(own) and (k := (own[left] << 32) | own[right]) in self.merge:
                    heappush(heap, (self.merge[k][0], left, k))
        return [t for t in own if t >= 0]

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        found = [self.proposed(w) for w in words]
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((t for f in found for t in f), np.int64, int(count.sum()))
        word = np.repeat(np.arange(len(words)), count)
        fails = np.zeros(len(words), bool)
        fails[word[~self.sound[ids]]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique((ids[inside] << 32) | ids[inside + 1], return_inverse=True)
        bad = self.crossed(pairs >> 32, pairs & 0xFFFFFFFF)
        fails[word[inside[bad[back]]]] = True
        for i in np.flatnonzero(fails):
            found[i] = self.merged(words[i])
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((t for f in found for t in f), np.int32, int(count.sum())), count


class Encoder:
    """Ids of texts by the tokenizer of a file; words that were met are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rule = json.load(f)
        model, pre = rule["model"], rule.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [])
        byte_level = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")]
        added = rule.get("added_tokens", [])
        plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if rule.get("normalizer") != NORMALIZER or not byte_level or steps[0] != SPLIT or model["type"] != "BPE" or any(odd) or not plain or rule.get("decoder"):
            raise ValueError(f"{path} is a tokenizer of another build")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.vocabulary = Vocabulary(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in added}
        self.special_at = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.kinds, self.asked = kinds().copy(), {0}
        names = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        text = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self.text_count = np.fromiter(map(len, text), np.int64, len(text))
        self.text_at = np.cumsum(self.text_count) - self.text_count
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.known = KeyTable()
        self.at, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _normalised(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the normalised texts and where each text begins; a special token is one code point beyond Unicode."""
        raw = data.tobytes()
        cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offs)
        starts[-1] = len(cp)
        low = lower_table()[cp]
        odd = np.unique(np.searchsorted(starts, np.flatnonzero(low < 0), "right") - 1)
        if self.special_at and any(s.encode() in raw for s in self.special):
            held = [i for i in range(len(offs) - 1) if any(s.encode() in raw[offs[i] : offs[i + 1]] for s in self.special)]
            odd = np.union1d(odd, np.array(held, np.int64))
        if not len(odd):
            return low, starts
        numbers = {s: _TOP + i for i, s in enumerate(self.special)}
        parts, sizes, done = [], np.diff(starts), 0
        for i in odd.tolist():
            parts.append(low[done : starts[i]])
            text, own = raw[offs[i] : offs[i + 1]].decode("utf-8", "replace"), []
            for piece in self.special_at.split(text) if self.special_at else [text]:
                own.append(np.array([numbers[piece]], np.int32) if piece in numbers else np.frombuffer(self.normalise(piece).encode("utf-32-le"), np.int32) if piece else np.zeros(0, np.int32))
            self._ask(own)
            parts += own
            sizes[i] = sum(map(len, own))
            done = starts[i + 1]
        parts.append(low[done:])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def _ask(self, parts: list[np.ndarray]) -> None:
        """Learn the kinds of characters that the library may know and Python does not."""
        for c in {c for own in parts for c in np.unique(own[own > 0x7F]).tolist()} - self.asked:
            self.asked.add(c)
            if c < _TOP and unicodedata.category(chr(c)) == "Cn":
                spans = [at for _, at in self.split("a" + chr(c) + "!")]
                by = {((0, 2), (2, 3)): _LETTER, ((0, 1), (1, 2), (2, 3)): _NUMBER, ((0, 1), (2, 3)): _WHITE}
                self.kinds[c] = by.get(tuple(spans), _OTHER)

    def _words(self, cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places at which words begin and end, and the kinds of all code points."""
        kind = np.where(cp < _TOP, self.kinds[np.minimum(cp, _TOP - 1)], _SPECIAL).astype(np.uint8)
        first = np.zeros(len(cp) + 1, bool)
        first[starts] = True
        cut = first[:-1] | (kind == _NUMBER) | (kind == _SPECIAL)
        cut[1:] |= kind[1:] != kind[:-1]
        # An apostrophe that begins a word and is followed by s, t, m, d, re, ve or ll takes these letters with it.
        q = np.flatnonzero((cp == 0x27) & cut)
        q = q[q + 1 < len(cp)]
        q = q[~first[q + 1] & (kind[q + 1] == _LETTER)]
        if len(q):
            one, after = cp[q + 1], np.minimum(q + 2, len(cp) - 1)
            two = np.where((q + 2 < len(cp)) & ~first[np.minimum(q + 2, len(cp))], cp[after], 0)
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = np.zeros(len(q), bool)
            for a, b in ("re", "ve", "ll"):
                double |= (one == ord(a)) & (two == ord(b))
            q, took = q[single | double], np.where(double, 2, 1)[single | double]
            cut[q + 1] = False
            rest = q + 1 + took
            cut[rest[rest < len(cp)]] = True
        places = np.flatnonzero(cut)
        ends = np.append(places[1:], len(cp))
        words = kind[places] != _WHITE
        return places[words], ends[words], kind

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        cp, starts = self._normalised(data, offs)
        begin, end, kind = self._words(cp, starts)
        special = np.flatnonzero(kind[begin] == _SPECIAL)
        special_ids = np.array(list(self.special.values()), np.int32)[cp[begin[special]] - _TOP] if len(special) else np.zeros(0, np.int32)
        cp = np.where(kind == _SPECIAL, 0, cp) if len(special) else cp
        text = cp.astype("<u4").tobytes().decode("utf-32-le").encode()
        byte = np.concatenate([[0], np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))])
        key = _HASH.of(np.frombuffer(text, np.uint8), byte[begin], byte[end])
        if self.known.count > KEPT:
            self._clear()
        place = self.known.find(key)
        new = np.flatnonzero(place < 0)
        if len(new):
            keys, at = np.unique(key[new], return_index=True)
            spans = zip(byte[begin[new[at]]].tolist(), byte[end[new[at]]].tolist(), strict=True)
            ids, count = self.vocabulary.encoded([text[a:b] for a, b in spans])
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
            self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
            self.known.add(keys)
            place[new] = self.known.find(key[new])
        count, at = self.count[place], self.at[place]
        count[special] = 1
        into = np.cumsum(count) - count
        source = np.repeat(at - into, count) + np.arange(int(count.sum()))
        if len(special):
            source[into[special]] = 0
        ids = self.ids[source] if len(source) else np.zeros(0, np.int32)
        ids[into[special]] = special_ids
        bounds = np.append(np.searchsorted(begin, starts[:-1]), len(begin))
        return ids, np.diff(np.append(into, len(ids))[bounds])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the decoded texts, the entries of each joined by a space, and their n + 1 offsets; ids without an entry are left out."""
        ids = np.where(ids < len(self.text_count), ids, len(self.text_count))
        size, at = np.append(self.text_count, 0)[ids], np.append(self.text_at, 0)[ids]
        into = np.cumsum(size) - size
        out = self.text[np.repeat(at - into, size) + np.arange(int(size.sum()))]
        ends = np.concatenate([[0], np.append(into, len(out))[np.cumsum(counts)]])
        last = ends[1:][np.diff(ends) > 0] - 1  # the space behind the last entry
        keep = np.ones(len(out), bool)
        keep[last] = False
        return out[keep], ends - np.searchsorted(last, ends)


def encoder(path: str) -> Encoder:
    """The encoder of this process for a tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def _packed(values: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(values)])


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row; ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for rows, data, offs in slices(batches):
            ids, count = enc.encode(data, offs)
            packed = _packed(ids.astype("<u4"), 4 * np.concatenate([[0], np.cumsum(count)]), pa.large_binary()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(count), packed], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The columns of ``encoded`` (``doc_id, n_tokens, ids``) and ``decoded``, the text of the ids with special tokens; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0)).astype(np.int64)
            ends, at = np.cumsum(size), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
                rows = batch.slice(at, to - at)
                raw = b"".join(v for v in rows.column(2).to_pylist() if v)
                text, offs = enc.decode(np.frombuffer(raw, "<u4").astype(np.int64), size[at:to] // 4)
                yield pa.RecordBatch.from_arrays([*rows.columns, _packed(text, offs, pa.large_string()).cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
                at = to

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
