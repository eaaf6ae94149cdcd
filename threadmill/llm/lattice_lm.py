"""Subword lattice likelihood.

A word, with the space before it, can be cut into pieces of an existing vocabulary in many ways; its probability is
the sum over all of them of the product of the pieces' probabilities, found by a forward recursion in log space over
all places of the word. Single bytes are always pieces, so every text has a probability. A text's probability is that of
its words and of an end symbol. Only the vocabulary is taken from the tokenizer file: the order of its scores gives the
first probabilities, and expectation maximisation over all training words (forward and backward sums,
weighted by counts) gives the final ones.

Beside it stands an add-0.1 unigram model of whole words, whose counts are of all training documents.

Counts, lattices and look-ups work on distinct words, dealt to buckets by hash in compressed runs: each task first
sums its own words, so a very frequent word reaches a bucket once per run of documents. Words that make up a
``1 / HOT`` part of all tokens or more (so ``HOT`` at most) are known to every task; for others a run of documents asks
the buckets once per distinct word. Words of ``LONG`` bytes or more are walked one by one, a stretch of places at a time.

Null texts count as empty and consist of the end symbol; repeated rows are scored alike; null ids stay; an empty table
gives no rows; without training documents N and V are 0 and the base score is that of the smoothing alone; further
columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, parts_for
from .textblocks import LOWER, KeyTable, PlaceHash, Words, mix64, slices, sums_by

RUN, HOT, ROUNDS, PRIOR = 32 << 20, 50_000, 3, 0.1
_WORD, _PIECE = PlaceHash(31), PlaceHash(37)
#: Bytes from which on a word is walked alone, and places that are looked up at a time in it.
LONG, STRETCH = 256, 1 << 16


def pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes) for a in arrays)
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    at, out = 4 + 10 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, 4 + 10 * i)
        kind = np.dtype(kind.decode())
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


@cache
def pieces(path: str) -> list[bytes]:
    """The vocabulary as byte strings, best score first, all single bytes included; a leading space stands for a word's begin."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scored: dict[bytes, float] = {bytes([b]): -1e9 for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        text = sp.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in text[1:]:
            scored[text] = max(scored.get(text, -1e9), sp.get_score(i))
    return [p for p, _ in sorted(scored.items(), key=lambda x: (-x[1], x[0]))]


@cache
def _piece_table(path: str) -> tuple[KeyTable, int]:
    own = pieces(path)
    data = np.frombuffer(b"".join(own), np.uint8)
    end = np.cumsum([len(p) for p in own])
    start = end - np.array([len(p) for p in own])
    table = KeyTable()
    table.add(_PIECE.of(data, start, end))
    return table, max(map(len, own))


def first_weights(path: str) -> np.ndarray:
    """Log probabilities of the pieces and of the end symbol (last), from the order of the vocabulary's scores."""
    q = 1 / (np.arange(len(pieces(path)) + 1) + 10.0)
    return np.log(q / q.sum())


class _Long:
    """The lattice of one long word: a stretch of places at a time, so that memory does not grow with places times pieces."""

    def __init__(self, path: str, logq: np.ndarray, word: np.ndarray):
        self.table, self.longest = _piece_table(path)
        self.logq, self.text = logq, np.concatenate([np.full(1, 32, np.uint8), word])

    def arcs(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and piece of all arcs that end at ``first`` or later and before ``last``, by end."""
        low = max(0, first - self.longest)
        text = self.text[low : last - 1].astype(np.int64)
        total, found = np.zeros(len(text), np.uint64), []
        for size in range(1, min(self.longest, len(text)) + 1):
            n = len(text) - size + 1
            total = total[:n] + _PIECE.value(text[size - 1 :].astype(np.uint64) | np.uint64((size - 1) << 8))
            piece = self.table.find(mix64(total))
            at = np.flatnonzero(piece >= 0)
            at = at[at + size + low >= first]
            found.append((at + low, at + low + size, piece[at]))
        begin, end, piece = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(end, kind="stable")
        return begin[order], end[order], piece[order]

    def walk(self, counted: float | None) -> tuple[float, np.ndarray | None]:
        """Log probability of the word, and the expected pieces times ``counted``."""
        width = len(self.text)
        alpha = self._sums(width, False)
        if counted is None:
            return float(alpha[width]), None
        beta, expected = self._sums(width, True), np.zeros(len(self.logq))
        for first in range(1, width + 1, STRETCH):
            begin, end, piece = self.arcs(first, min(first + STRETCH, width + 1))
            expected += np.bincount(piece, np.exp(alpha[begin] + self.logq[piece] + beta[end] - alpha[width]) * counted, len(self.logq))
        return float(alpha[width]), expected

    def _sums(self, width: int, back: bool) -> np.ndarray:
        """Log sums over all segmentations before each place (or after it). Sums are carried as plain numbers beside a
        common logarithm, which is renewed before they become too small."""
        out = np.full(width + 1, -np.inf)
        near, scale = {width if back else 0: 1.0}, 0.0
        out[width if back else 0] = 0.0
        firsts = range(1, width + 1, STRETCH)
        for first in reversed(firsts) if back else firsts:
            begin, end, piece = self.arcs(first, min(first + STRETCH, width + 1))
            if back:
                order = np.lexsort((-begin, -end))
                begin, end, piece = end[order], begin[order], piece[order]
            now, least = -1, 1.0
            for a, b, q in zip(begin.tolist(), end.tolist(), np.exp(self.logq[piece]).tolist(), strict=True):
                if back:  # a place's own sum is complete when arcs that end at it are met
                    if a != now:
                        now, least = a, near.get(a, 0.0)
                        out[a] = math.log(least) + scale if least else -np.inf
                        near.pop(a + self.longest + 1, None)
                    if least:
                        near[b] = near.get(b, 0.0) + least * q
                else:
                    if b != now:
                        if now >= 0:
                            out[now] = math.log(near[now]) + scale if near.get(now) else -np.inf
                            near.pop(now - self.longest - 1, None)
                        now = b
                    near[b] = near.get(b, 0.0) + near.get(a, 0.0) * q
                    least = near[b]
                if 0.0 < least < 1e-150:
                    near = {k: v * 1e150 for k, v in near.items()}
                    scale -= 150 * math.log(10)
                    least = near[now]
            if not back and now >= 0 and near.get(now):
                out[now] = math.log(near[now]) + scale
        if back:
            out[0] = math.log(near[0]) + scale if near.get(0) else -np.inf
        return out


def lattices(path: str, logq: np.ndarray, word_bytes: np.ndarray, size: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each word; with counts also the expected count of each piece."""
    table, longest = _piece_table(path)
    logp, expected = np.zeros(len(size)), np.zeros(len(logq))
    begin = np.cumsum(size) - size
    order = np.argsort(size, kind="stable")
    short = int(np.searchsorted(size[order], LONG))
    for i in order[short:]:
        word = _Long(path, logq, word_bytes[begin[i] : begin[i] + size[i]])
        logp[i], own = word.walk(None if count is None else float(count[i]))
        expected += 0 if own is None else own
    at = 0
    while at < short:
        n = int(size[order[at]])
        # Words of one length, about a million bytes at a time.
        to = min(int(np.searchsorted(size[order], n, "right")), at + max(1, (1 << 20) // (n + 1)))
        own = order[at:to]
        at, m, width = to, to - at, n + 1
        text = np.full((width, m), 32, np.uint64)
        text[1:] = word_bytes[begin[own] + np.arange(n)[:, None]]
        # Of each begin, the hash of the bytes up to the present end.
        total = np.zeros((width, m), np.uint64)
        arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(width + 1)]
        for e in range(1, width + 1):
            first = max(0, e - longest)
            total[first:e] += _PIECE.near[(np.arange(e - 1 - first, -1, -1)[:, None] << 8) + text[e - 1].astype(np.int64)]
            piece = table.find(mix64(total[first:e]).ravel()).reshape(e - first, m)
            for s in range(first, e):
                has = np.flatnonzero(piece[s - first] >= 0)
                if len(has):
                    arcs[e].append((s, has, piece[s - first][has]))
        alpha = np.full((width + 1, m), -np.inf)
        alpha[0] = 0
        for e in range(1, width + 1):
            for s, has, piece in arcs[e]:
                alpha[e, has] = np.logaddexp(alpha[e, has], alpha[s, has] + logq[piece])
        logp[own] = alpha[width]
        if count is None:
            continue
        beta = np.full((width + 1, m), -np.inf)
        beta[width] = 0
        weight = count[own].astype(float)
        for e in range(width, 0, -1):
            for s, has, piece in arcs[e]:
                through = logq[piece] + beta[e, has]
                beta[s, has] = np.logaddexp(beta[s, has], through)
                expected += np.bincount(piece, np.exp(alpha[s, has] + through - alpha[width, has]) * weight[has], len(logq))
    return logp, expected


class _Run:
    """Distinct words of a run of documents, numbered as they are met."""

    def __init__(self, keep_bytes: bool):
        self.table, self.keep, self.size = KeyTable(), keep_bytes, 0
        self.keys: list[np.ndarray] = []
        self.parts: list[bytes] = []
        self.lens: list[np.ndarray] = []

    def numbers(self, key: np.ndarray, words: Words, text: np.ndarray) -> np.ndarray:
        number = self.table.find(key)
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, first = np.unique(key[new], return_index=True)
            self.table.add(distinct)
            self.keys.append(distinct)
            if self.keep:
                start, end = words.start[new[first]], words.end[new[first]]
                count = end - start
                self.lens.append(count)
                self.parts.append(text[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())].tobytes())
            number[new] = self.table.find(key[new])
        return number


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return np.pad(a, (0, max(0, n - len(a))))


def _vocabulary(n: int):
    """Rows ``bucket, blob`` of the distinct words of each run: keys, training count, count, lengths, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            keys, lens = np.concatenate(mine.keys), np.concatenate(mine.lens)
            data, begin = np.frombuffer(b"".join(mine.parts), np.uint8), np.cumsum(lens) - lens
            bucket = (keys % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows: tuple[list, list] = ([], [])
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                c = lens[part]
                raw = data[np.repeat(begin[part] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
                rows[0].append(int(bucket[part[0]]))
                rows[1].append(pack(keys[part], trained[part].astype(np.uint32), counted[part].astype(np.uint32), c.astype(np.uint32), raw))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], ["bucket", "blob"])

        mine, trained, counted = _Run(True), np.zeros(0), np.zeros(0)
        for rows, data, offs in slices(batches):
            text = LOWER[data]
            words = Words(text, offs)
            number = mine.numbers(_WORD.of(text, words.start, words.end), words, text)
            train = np.repeat(rows.column(1).to_numpy(zero_copy_only=False).astype(float), words.counts())
            trained = _grown(trained, mine.table.count) + np.bincount(number, train, mine.table.count)
            counted = _grown(counted, mine.table.count) + np.bincount(number, minlength=mine.table.count)
            mine.size += len(data)
            if mine.size > RUN:
                yield flush()
                mine, trained, counted = _Run(True), np.zeros(0), np.zeros(0)
        if mine.table.count:
            yield flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket: the distinct words with their summed counts."""
    runs: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            runs.setdefault(bucket, []).append(unpack(blob.as_py()))
    for bucket, got in runs.items():
        keys, trained, counted, lens, data = (np.concatenate([g[i] for g in got]) for i in range(5))
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        trained, counted = np.bincount(back, trained, len(distinct)), np.bincount(back, counted, len(distinct))
        begin = (np.cumsum(lens.astype(np.int64)) - lens)[first]
        c = lens[first].astype(np.int64)
        raw = data[np.repeat(begin - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([int((trained > 0).sum())]), pa.array([int(trained.sum())]), pa.array([int(counted.sum())]),
             pa.array([pack(distinct, trained.astype(np.uint64), counted.astype(np.uint64), c, raw)], pa.binary())],
            ["bucket", "v", "n", "n_all", "blob"],
        )


def _expected(path: str, logq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(logq))
        for batch in batches:
            for blob in batch.column(0):
                _, trained, _, lens, data = unpack(blob.as_py())
                own = trained > 0
                begin, c = (np.cumsum(lens) - lens)[own], lens[own]
                raw = data[np.repeat(begin - (np.cumsum(c) - c), c) + np.arange(c.sum())]
                total += lattices(path, logq, raw, c, trained[own])[1]
        p = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(total[p])], ["piece", "n"])

    return run


def _judged(path: str, logq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column(0), batch.column(1), strict=True):
                keys, trained, counted, lens, data = unpack(blob.as_py())
                lat = lattices(path, logq, data, lens)[0] / np.log(10)
                yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()], pa.int32()), pa.array([pack(keys, trained, counted, lat)], pa.binary())], ["bucket", "blob"])

    return run


def _asked(n: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Runs of documents, with what the hot words give, and the words that each run asks of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = KeyTable()
        table.add(hot[0])
        log_c, known, lat = np.log10(hot[1] + PRIOR), (hot[1] > 0).astype(float), hot[2]
        task, seq = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([np.zeros(0, np.uint64), *mine.keys])
            bucket = (keys % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            renumber = np.empty(len(order), np.uint32)
            renumber[order] = np.arange(len(order))
            ids, null, held, count, base, seen, score, rest, number = (np.concatenate([h[i] for h in docs]) for i in range(9))
            chunk = (task << 32) | seq
            rows: tuple[list, list, list, list] = (["run"], [0], [chunk], [pack(ids, null, held, count, base, seen, score, rest, renumber[number])])
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                for column, v in zip(rows, ("ask", int(bucket[part[0]]), chunk, pack(keys[part])), strict=True):
                    column.append(v)
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], ["kind", "bucket", "chunk", "blob"])

        mine, docs = _Run(False), []
        for rows, data, offs in slices(batches, "text"):
            text = LOWER[data]
            words = Words(text, offs)
            key = _WORD.of(text, words.start, words.end)
            at = table.find(key)
            own = at >= 0
            n_words = words.counts()
            total = lambda v: sums_by(n_words, np.where(own, v[np.maximum(at, 0)], 0.0) if len(v) else np.zeros(len(at)))  # noqa: E731, B023
            ids = rows.column(0)
            number = mine.numbers(key[~own], words, text)
            docs.append((ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()).astype(np.uint8), (~rows.column(1).to_numpy(zero_copy_only=False).astype(bool)).astype(np.uint8),
                         n_words.astype(np.int64), total(log_c), total(known), total(lat), sums_by(n_words, (~own).astype(np.int64)), number.astype(np.uint32)))
            mine.size += len(data)
            if mine.size > RUN:
                yield flush()
                mine, docs, seq = _Run(False), [], seq + 1
        if docs:
            yield flush()

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a bucket knows of the words that it was asked for, in the order of the question."""
    words: dict[int, list[np.ndarray]] = {}
    asked: list[tuple[int, int, np.ndarray]] = []
    for batch in batches:
        for kind, bucket, chunk, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == "ask":
                asked.append((bucket, chunk, unpack(blob)[0]))
            else:
                words[bucket] = unpack(blob)
    tables = {}
    for bucket, got in words.items():
        tables[bucket] = KeyTable()
        tables[bucket].add(got[0])
    for bucket, chunk, keys in asked:
        at = tables[bucket].find(keys)
        blob = pack(words[bucket][1][at], words[bucket][3][at])
        yield pa.RecordBatch.from_arrays([pa.array(["answer"]), pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], ["kind", "bucket", "chunk", "blob"])


def _scored(end: tuple[float, float, float, int]):
    """Per document the sums over hot words, answered words and the end symbol."""
    end_log_c, end_known, end_score, train_tokens = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, bytes] = {}
        answers: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for kind, bucket, chunk, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == "run":
                    chunks[chunk] = blob
                else:
                    answers.setdefault(chunk, []).append((bucket, blob))
        for chunk, blob in chunks.items():
            ids, null, held, count, base, seen, score, rest, number = unpack(blob)
            got = [unpack(b) for _, b in sorted(answers.get(chunk, []))]
            trained = np.concatenate([np.zeros(0), *[g[0] for g in got]])[number]
            lat = np.concatenate([np.zeros(0), *[g[1] for g in got]])[number]
            base = base + sums_by(rest, np.log10(trained + PRIOR)) + end_log_c
            seen = seen + sums_by(rest, (trained > 0).astype(float)) + end_known
            score = score + sums_by(rest, lat) + end_score
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(count + 1), pa.array(seen.astype(np.int64)),
                 pa.array(np.full(len(ids), train_tokens, np.int64)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_sum", "score"],
            )

    return run


def score(docs: DataFrame, learn: Column, vocabulary: str, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``learn`` says which documents are learned from. What goes to the driver is a count per piece of the vocabulary,
    totals, and at most ``HOT`` words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    n = parts_for(docs, 128)
    spread = parts_for(docs, 24)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), learn.alias("learn"), F.col(text_col).cast("string").alias("text"))
    found = rows.select("text", "learn").mapInArrow(_vocabulary(n), "bucket int, blob binary")
    words = scratch.put(found.repartitionById(n, F.col("bucket")).mapInArrow(_merge, "bucket int, v long, n long, n_all long, blob binary"), "words")
    v, tokens, all_tokens = (x or 0 for x in words.agg(F.sum("v"), F.sum("n"), F.sum("n_all")).first())
    train_docs, all_docs = (x or 0 for x in rows.agg(F.count_if("learn"), F.count("*")).first())
    v, tokens = v + (train_docs > 0), tokens + train_docs
    logq = first_weights(vocabulary)
    for _ in range(rounds):
        sums = np.full(len(logq), PRIOR)
        got = words.select("blob").repartition(n).mapInArrow(_expected(vocabulary, logq), "piece int, n double").groupBy("piece").agg(F.sum("n")).collect()
        for piece, expected in got:
            sums[piece] += expected
        sums[-1] += train_docs
        logq = np.log(sums / sums.sum())
    judged = scratch.put(words.select("bucket", "blob").repartition(n, "bucket").mapInArrow(_judged(vocabulary, logq), "bucket int, blob binary"), "judged")

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                keys, trained, counted, lat = unpack(blob.as_py())
                own = counted * HOT >= all_tokens
                yield pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), pa.array(trained[own].astype(float)), pa.array(lat[own])], ["key", "trained", "lat"])

    top = judged.select("blob").mapInArrow(hot, "key long, trained double, lat double").collect()
    top = (np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], float), np.array([r[2] for r in top], float))
    scratch.drop("words")
    asked = rows.select("doc_id", "learn", "text").mapInArrow(_asked(n, top), "kind string, bucket int, chunk long, blob binary")
    asked.write.partitionBy("kind").parquet(scratch.path("asked"))
    schema = "bucket int, chunk long, blob binary, kind string"
    asked = spark.read.schema(schema).parquet(scratch.path("asked")).select("kind", "bucket", "chunk", "blob")
    known = judged.select(F.lit("words").alias("kind"), "bucket", F.lit(0).cast("long").alias("chunk"), "blob")
    answers = asked.where("kind = 'ask'").unionByName(known).repartitionById(n, F.col("bucket"))
    answers = answers.mapInArrow(_answered, "kind string, bucket int, chunk long, blob binary")
    both = asked.where("kind = 'run'").unionByName(answers).repartition(spread, "chunk")
    end = (float(np.log10(train_docs + PRIOR)), float(train_docs > 0), float(logq[-1] / np.log(10)), int(tokens))
    per_token = float(np.log10(tokens + PRIOR * (v + 1)))
    out = both.mapInArrow(_scored(end), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_sum double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.col("base_sum") - F.col("n_tokens") * per_token).alias("base_score"), "score")
