"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its hashed words (share of its words), standardised structure statistics of the whole
text and the declared length. With weights w and low-rank factors V the score is the logistic function of

    w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)**2 - sum v_if**2 x_i**2]

which takes time linear in the number of features. The model is fitted on the driver from a bounded sample of
labelled rows (``SAMPLE`` rows, those with the smallest hash of their id, and of these so many that their features take up ``SAMPLE_BYTES``
at most); all documents are scored in place, without a shuffle.

Null and empty texts have no words and are scored from their statistics; null lengths count as the text's own
length; repeated rows are scored alike; labels that are null are left out, and of several labels of an id the
largest counts; of several rows of a labelled id one is learnt from; without any labels every score is 0.5; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textblocks import LOWER, PlaceHash, Words, slices, sums_by

SAMPLE, SAMPLE_BYTES = 12_000, 256 << 20
BITS, FACTORS = 15, 8
_HASH = PlaceHash(11)

#: Byte classes of the structure statistics.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
_CLASS[[ord(c) for c in "!#$%&*+=@^_`~\\/"]] = 5
_CLASS[[ord(c) for c in "|<>[]{}"]] = 6
_CLASS[ord("\n")] = 7
_CLASS[[ord(c) for c in " \t\r\v\f"]] = 8
_CLASS[128:] = 9
_CLASSES = 10
STATS = _CLASSES - 1 + 7


def _features(data: np.ndarray, offs: np.ndarray, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document the number of its word features; all their indices and values; the statistics."""
    words, docs = Words(data, offs), len(offs) - 1
    n, size = words.counts(), np.diff(offs)
    digest = _HASH.of(LOWER[data], words.start, words.end)
    again = np.zeros(len(digest))
    again[1:] = digest[1:] == digest[:-1]
    key = np.sort((words.doc_of().astype(np.int64) << BITS) | (digest >> np.uint64(64 - BITS)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(key)]]))
    doc = key[first] >> BITS
    per_doc = np.bincount(doc, minlength=docs)
    value = (count / np.maximum(n, 1)[doc]).astype(np.float32)
    kinds = np.bincount(np.repeat(np.arange(docs), size) * _CLASSES + _CLASS[data], minlength=docs * _CLASSES)
    kinds = kinds.reshape(docs, _CLASSES)[:, 1:] / np.maximum(size, 1)[:, None]
    length = words.end - words.start
    most = np.zeros(docs)
    most[n > 0] = np.maximum.reduceat(length, words.doc[:-1][n > 0]) if len(length) else 0
    square = sums_by(n, length.astype(np.float64) ** 2) / np.maximum(n, 1)
    mean = sums_by(n, length.astype(np.float64)) / np.maximum(n, 1)
    declared = np.where(np.isnan(declared), size, declared)
    more = [np.log1p(n), np.log1p(np.maximum(declared, 0)), mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(most), per_doc / np.maximum(n, 1), sums_by(n, again) / np.maximum(n, 1)]
    return per_doc, key[first] & ((1 << BITS) - 1), value, np.column_stack([kinds, *more]).astype(np.float32)


@dataclass
class Model:
    """Weights and factors; the statistics come after the hashed words."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def margin(self, per_doc: np.ndarray, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -6, 6)
        words = 1 << BITS
        linear = self.w0 + sums_by(per_doc, self.w[index] * value) + z @ self.w[words:]
        s = sums_by(per_doc, self.v[index] * value[:, None]) + z @ self.v[words:]
        q = sums_by(per_doc, (self.v[index] * value[:, None]) ** 2) + z**2 @ self.v[words:] ** 2
        return linear + 0.5 * (s**2 - q).sum(axis=1)


def fit(labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 14, rate: float = 0.08, decay: float = 2e-5) -> Model:
    """Adagrad on the logistic loss. ``rows``: word indices, values and statistics of each labelled document."""
    rng = np.random.default_rng(5)
    words = 1 << BITS
    stats = np.stack([r[2] for r in rows]).astype(np.float32)
    mean, sd = stats.mean(axis=0), stats.std(axis=0) + 1e-4
    z = np.clip((stats - mean) / sd, -6, 6)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    w0, w = float(np.log(share / (1 - share))), np.zeros(words + stats.shape[1], np.float32)
    v = rng.normal(0, 0.03, (len(w), FACTORS)).astype(np.float32)
    gw, gv, g0 = np.full(len(w), 1e-2, np.float32), np.full(v.shape, 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            per = np.array([len(rows[i][0]) for i in part])
            index = np.concatenate([rows[i][0] for i in part]).astype(np.int64)
            x = np.concatenate([rows[i][1] for i in part])
            doc = np.repeat(np.arange(len(part)), per)
            zz, vx = z[part], v[index] * x[:, None]
            s = sums_by(per, vx) + zz @ v[words:]
            q = sums_by(per, vx**2) + zz**2 @ v[words:] ** 2
            y = w0 + sums_by(per, w[index] * x) + zz @ w[words:] + 0.5 * (s**2 - q).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]).astype(np.float32) / len(part)
            u, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, err[doc] * x, len(u)).astype(np.float32) + decay * w[u]
            each = err[doc][:, None] * (x[:, None] * s[doc] - v[index] * (x**2)[:, None])
            dv = np.column_stack([np.bincount(back, each[:, f], len(u)) for f in range(FACTORS)]).astype(np.float32) + decay * v[u]
            sw = zz.T @ err
            sv = zz.T @ (err[:, None] * s) - v[words:] * ((zz**2).T @ err)[:, None]
            gw[u] += dw**2
            gv[u] += dv**2
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= rate * dv / np.sqrt(gv[u])
            gw[words:] += sw**2
            gv[words:] += sv**2
            w[words:] -= rate * sw / np.sqrt(gw[words:])
            v[words:] -= rate * 0.3 * sv / np.sqrt(gv[words:])
            g0 += err.sum() ** 2
            w0 -= rate * float(err.sum()) / g0**0.5
    return Model(w0, w, v, mean, sd)


def _declared(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit on at most ``sample`` rows of ``labels`` (``doc_id, label``) for which ``learn`` holds, with ``sample_bytes`` of features at most."""
    known = labels.where(F.col("label").isNotNull() & learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            per, index, value, stats = _features(data, offs, _declared(rows))
            cut = np.cumsum(per) - per
            parts = [(index[a : a + n].astype(np.int32).tobytes(), value[a : a + n].tobytes()) for a, n in zip(cut, per, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(3), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())],
                ["doc_id", "label", "words", "shares", "stats"],
            )
        pa.default_memory_pool().release_unused()  # the worker stays for later stages

    # The sample is bounded by its parameter, so it may be broadcast.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("double").alias("n_chars"))
    rows = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "n_chars", F.col("label").cast("int").alias("label"))
    # One row of each id, that with the smallest digest of its text: an id may have any number of rows.
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "n_chars", "label"), F.struct(F.xxhash64("text"), "text", "n_chars")).alias("r"))
    rows = one.select("doc_id", "r.text", "r.n_chars", "r.label")
    scratch = Scratch(docs.sparkSession, "quality")
    made = scratch.put(rows.mapInArrow(extract, "doc_id long, label int, words binary, shares binary, stats binary"), "features")
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # of ``sample`` rows at most
    small = made.select("doc_id", F.sum(F.length("words") + F.length("shares") + F.length("stats")).over(so_far).alias("size")).where(F.col("size") <= sample_bytes)
    got = made.join(F.broadcast(small.select("doc_id")), "doc_id").collect()
    scratch.drop()
    if not got:
        return None
    rows = [(np.frombuffer(r.words, np.int32), np.frombuffer(r.shares, np.float32), np.frombuffer(r.stats, np.float32)) for r in got]
    order = sorted(range(len(rows)), key=lambda i: (got[i].words, got[i].stats, got[i].label))
    return fit(np.array([got[i].label for i in order], np.float32), [rows[i] for i in order])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``row, score`` for every document ``doc_id, text, n_chars``; ``row`` is a struct of all its columns."""
    used = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("double").alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            y = np.zeros(rows.num_rows) if model is None else model.margin(*_features(data, offs, _declared(rows)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(1 / (1 + np.exp(-np.clip(y, -30, 30))), pa.float64())], ["row", "score"])
        pa.default_memory_pool().release_unused()

    return used.mapInArrow(run, used.select("row").schema.add("score", "double"))
