"""Runs of documents that ask buckets of keys and get answers: an exchange of compressed arrays.

A run is one row: some megabytes of consecutive documents. A pass over the runs yields questions ``bucket, run, blob``, each
bucket answers all questions that it got with one row per question, and the next pass meets each run with its answers.
A run asks about a key once however often it has it, so a very frequent key costs a bucket one entry per run. Runs,
and answers, are written tables; every pass can be repeated from them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice_lm import pack, unpack
from .scratch import Scratch, parts_for
from .textblocks import slices

NO_ID = -(1 << 63)
MESSAGE = "bucket int, run long, blob binary"


class Documents:
    """The documents of a run: ids (``NO_ID`` for null), their bytes and offsets."""

    def __init__(self, blob: bytes):
        self.ids, self.offs, self.data = unpack(blob)


def _cut(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            offs = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))]).astype(np.int64)
            blob = pack(ids, offs, np.concatenate([h[1] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) | seq]), pa.array([blob], pa.binary())], ["run", "blob"])

        for rows, data, offs in slices(batches):
            held.append((rows.column(0).fill_null(NO_ID).to_numpy(), data, offs))
            size += len(data)
            if size > limit:
                yield flush()
                held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return run


class Exchange:
    def __init__(self, docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 3 << 20):
        self.scratch = Scratch(docs.sparkSession, name)
        self.buckets, self.parts = parts_for(docs, 24), parts_for(docs, 16)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.runs = self.scratch.put(rows.mapInArrow(_cut(limit), "run long, blob binary"), "runs")

    def passed(self, work: Callable[[int, Documents, list[list[bytes]]], Iterator[pa.RecordBatch]], schema: str, answers: list[DataFrame]) -> DataFrame:
        """``work(run, documents, answers)`` for every run; answers are, for each table, the blobs by ascending bucket."""
        known = self.runs.select(F.lit(-1).alias("kind"), F.lit(0).alias("bucket"), "run", "blob")
        for i, a in enumerate(answers):
            known = known.unionByName(a.select(F.lit(i).alias("kind"), "bucket", "run", "blob"))
        if answers:
            known = known.repartition(self.parts, "run")
        n = len(answers)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs: dict[int, bytes] = {}
            got: dict[int, list[tuple[int, int, bytes]]] = {}
            for batch in batches:
                for kind, bucket, run, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if kind >= 0:
                        got.setdefault(run, []).append((kind, bucket, blob))
                    elif n:
                        runs[run] = blob
                    else:
                        yield from work(run, Documents(blob), [])
            for run, blob in runs.items():
                mine = sorted(got.pop(run, []))
                yield from work(run, Documents(blob), [[b for k, _, b in mine if k == i] for i in range(n)])

        return known.mapInArrow(go, schema)

    def answered(self, questions: DataFrame, reply: Callable[..., list[np.ndarray]], table: str, runs: bool = False) -> DataFrame:
        """``reply`` gets the arrays of all questions to a bucket (and before them the runs that asked, if it wants them)
        and returns an array for each question."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked: dict[int, list[tuple[int, bytes]]] = {}
            for batch in batches:
                for bucket, run, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    asked.setdefault(bucket, []).append((run, blob))
            for bucket, rows in asked.items():
                arrays = [unpack(b) for _, b in rows]
                out = [pack(a) for a in (reply([r for r, _ in rows], arrays) if runs else reply(arrays))]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int32()), pa.array([r for r, _ in rows]), pa.array(out, pa.binary())], ["bucket", "run", "blob"])

        dealt = questions.repartitionById(self.buckets, F.col("bucket"))
        return self.scratch.put(dealt.mapInArrow(go, MESSAGE), table)


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the keys by bucket, and for each bucket that has any (bucket, from, to) in that order."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return order, [(int(bucket[order[a]]), int(a), int(b)) for a, b in zip(cut, np.append(cut, len(order))[1:], strict=True)]


def message(run: int, parts: list[tuple[int, int, int]], *arrays: np.ndarray) -> pa.RecordBatch:
    """Questions of a run from arrays that are in bucket order."""
    blobs = [pack(*[a[s:e] for a in arrays]) for _, s, e in parts]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int32()), pa.array([run] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "run", "blob"])


def shared(questions: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For keys with counts (and further digits of the keys): whether a key's total is over one, as packed bits."""
    keys = np.concatenate([q[0] for q in questions])
    count = np.concatenate([q[1] for q in questions])
    more = np.concatenate([q[2] for q in questions]) if len(questions[0]) > 2 else np.zeros(len(keys), np.uint32)
    order = np.lexsort((more, keys))
    k, m = keys[order], more[order]
    first = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])
    group = np.cumsum(first) - 1
    many = np.bincount(group, count[order]) > 1
    out = np.zeros(len(keys), bool)
    out[order] = many[group]
    return [np.packbits(x) for x in np.split(out, np.cumsum([len(q[0]) for q in questions])[:-1])]


def bits(blobs: list[bytes], sizes: list[int]) -> np.ndarray:
    """Answers of ``shared`` to consecutive parts of so many keys, as one array."""
    parts = [np.unpackbits(unpack(b)[0], count=n).astype(bool) for b, n in zip(blobs, sizes, strict=True)]
    return np.concatenate([np.zeros(0, bool), *parts])
