"""Token ids in a compressed binary format: static range asymmetric numeral systems.

One frequency table, counted over all ids, is shared by all blocks. A block holds whole documents in ascending order
of their ids and can be decoded alone: its ids are dealt to interleaved lanes with a 64-bit state each, 32-bit words
are written in the order in which the lanes read them, lane states are kept as checkpoints every ``EVERY`` steps, and a
CRC-32 closes the block. Blocks are rows of a Parquet table ``blocks`` (so that writers commit and retry like any
other), the frequency table lies beside them as ``table``.

Null texts count as empty and consist of the end id; null document ids come first; rows with equal ids are ordered by
their ids' checksum; repeated rows are written repeatedly; an empty table gives no block and an empty result;
further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import encoder
from .scratch import Scratch, parts_for
from .textblocks import slices

SCALE, LANES, EVERY, BLOCK = 20, 2048, 128, 1 << 19
LOW = np.uint64(1 << 31)
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<4sIQQIIII")  # magic, version, start, ids, documents, lanes, checkpoints, bytes of the index
_S, _W, _MASK, _WORD = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1), np.uint64(0xFFFFFFFF)


class Table:
    """Frequencies of the symbols, scaled to a sum of 2**SCALE."""

    def __init__(self, symbol: np.ndarray, freq: np.ndarray):
        top = int(symbol.max()) + 1 if len(symbol) else 1
        self.freq, self.base = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.freq[symbol] = freq
        self.base[1:] = np.cumsum(self.freq)[:-1]
        self.slot = np.repeat(np.arange(top, dtype=np.int32), self.freq.astype(np.int64))

    @staticmethod
    def scaled(count: np.ndarray) -> np.ndarray:
        """Every symbol that occurs keeps at least one slot; rounding is settled on the most frequent ones."""
        total = 1 << SCALE
        freq = np.maximum(1, np.round(count * (total / count.sum()))).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        while (over := int(freq.sum()) - total) != 0:
            part = order[: max(1, min(len(order), abs(over)))]
            part = part[freq[part] > 1] if over > 0 else part
            freq[part[: abs(over)]] -= np.sign(over)
        return freq


def encode_block(ids: np.ndarray, table: Table, start: int, doc_ids: np.ndarray, counts: np.ndarray) -> bytes:
    lanes = max(1, min(LANES, len(ids) // 16))
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, LOW, np.uint64)
    f_all, c_all = table.freq[ids], table.base[ids]
    most = ((LOW >> _S) << _W) * f_all
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    points: list[tuple[int, np.ndarray]] = []
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(len(ids), (t + 1) * lanes)
        f, own = f_all[a:b], x[: b - a]
        out = own >= most[a:b]
        words[t] = (own[out] & _WORD).astype(np.uint32)
        own = np.where(out, own >> _W, own)
        q = own // f
        x[: b - a] = (q << _S) + (own - q * f) + c_all[a:b]
        if t % EVERY == 0 and t:
            points.append((t, x.copy()))
    points.append((0, x.copy()))
    size = np.cumsum([0, *map(len, words)])
    index = zstandard.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + counts.astype("<u4").tobytes(), 3)
    states = b"".join(struct.pack("<IQ", t, int(size[t])) + s.astype("<u8").tobytes() for t, s in reversed(points))
    head = _HEAD.pack(b"TMRB", 1, start, len(ids), len(doc_ids), lanes, len(points), len(index))
    payload = head + index + states + np.concatenate([np.zeros(0, np.uint32), *words]).astype("<u4").tobytes()
    return payload + struct.pack("<I", zlib.crc32(payload))


def decode_block(payload: bytes, table: Table, checkpoint: int = 0) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first id, ids (those from a checkpoint on), document ids and counts. Raises on a damaged block."""
    if len(payload) < _HEAD.size + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("the checksum of a token block does not match")
    magic, version, start, n, docs, lanes, points, size = _HEAD.unpack_from(payload)
    if magic != b"TMRB" or version != 1:
        raise ValueError("not a token block of this version")
    index = zstandard.decompress(payload[_HEAD.size : _HEAD.size + size])
    doc_ids = np.cumsum(np.frombuffer(index, "<i8", docs))
    counts = np.frombuffer(index, "<u4", docs, docs * 8).astype(np.int64)
    at, each = _HEAD.size + size, 12 + 8 * lanes
    words = np.frombuffer(payload[at + points * each : -4], "<u4").astype(np.uint64)
    step, read = struct.unpack_from("<IQ", payload, at + checkpoint * each)
    x = np.frombuffer(payload, "<u8", lanes, at + checkpoint * each + 12).copy()
    first = step * lanes
    out = np.zeros(n - first, np.int32)
    for a in range(first, n, lanes):
        b = min(n, a + lanes)
        own = x[: b - a]
        slot = own & _MASK
        s = table.slot[slot]
        out[a - first : b - first] = s
        own = table.freq[s] * (own >> _S) + slot - table.base[s]
        low = np.flatnonzero(own < LOW)
        own[low] = (own[low] << _W) | words[read : read + len(low)]
        read += len(low)
        x[: b - a] = own
    return start, out, doc_ids, counts


def _staged(docs: DataFrame, path: str, end_id: int, bounds: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Ids of each document, in compressed runs of documents of one bucket: ``bucket, n, ids``."""

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        doc, count = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        ids = np.concatenate([h[2] for h in held])
        at = np.cumsum(count) - count
        bucket = np.searchsorted(bounds, doc, "right")
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        rows: tuple[list, list, list] = ([], [], [])
        for part in np.split(order, cut[1:]):
            own = np.concatenate([ids[at[i] : at[i] + count[i]] for i in part])
            raw = struct.pack("<IB", len(part), own.itemsize) + doc[part].astype("<i8").tobytes() + count[part].astype("<u4").tobytes() + own.tobytes()
            for column, v in zip(rows, (int(bucket[part[0]]), len(own), zstandard.compress(raw, 1)), strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["bucket", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, size = encoder(path), [], 0
        kind = "<u2" if enc.size <= 1 << 16 else "<u4"
        for rows, data, offs in slices(batches):
            ids, count = enc.encode(data, offs)
            out = np.full(len(ids) + len(count), end_id, kind)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
            held.append((rows.column(0).fill_null(NO_ID).to_numpy(), count + 1, out))
            size += len(out)
            if size > 1 << 20:
                yield flush(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()  # a worker shares its executor's memory with others
        if held:
            yield flush(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "bucket int, n long, ids binary")


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, width = struct.unpack_from("<IB", raw)  # documents, bytes of an id
    at = 5
    return np.frombuffer(raw, "<i8", n, at), np.frombuffer(raw, "<u4", n, at + 8 * n).astype(np.int64), np.frombuffer(raw[at + 12 * n :], f"<u{width}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write ``folder/blocks`` and ``folder/table``.

    Documents are dealt to ranges of ids (quantiles, about 24 MB of input each), so blocks ascend by range. What goes
    to the driver is one count per symbol of the vocabulary and one per range; it does not open the tokenizer.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    n = parts_for(docs)
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64)) if n > 1 else np.zeros(0, np.int64)
    staged = scratch.put(_staged(docs, tokenizer, end_id, bounds, id_col, text_col), "staged")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                c = np.bincount(_unpack(blob.as_py())[2])
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
        s = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(total[s])], ["symbol", "n"])

    counts = staged.select("ids").mapInArrow(count, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol").collect()
    symbol, freq = np.array([r[0] for r in counts], np.int64), np.zeros(0, np.int64)
    if counts:
        freq = Table.scaled(np.array([r[1] for r in counts], np.int64))
    pairs = [(int(s), int(f)) for s, f in zip(symbol, freq, strict=True)]
    spark.createDataFrame(pairs, "symbol int, freq int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/table")
    table = Table(symbol, freq)
    ranges = len(bounds) + 1
    base = np.zeros(ranges + 1, np.int64)
    for bucket, ids in staged.groupBy("bucket").agg(F.sum("n")).collect():
        base[bucket + 1] = ids
    base = np.cumsum(base)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs.setdefault(bucket, []).append(_unpack(blob.as_py()))
        for bucket in sorted(runs):
            doc, cnt, ids = (np.concatenate([r[i] for r in runs[bucket]]) for i in range(3))
            at = np.cumsum(cnt) - cnt
            tie = np.zeros(len(doc), np.int64)
            again = np.isin(doc, np.unique(doc[np.argsort(doc, kind="stable")][1:][np.diff(np.sort(doc)) == 0]))
            for i in np.flatnonzero(again):
                tie[i] = zlib.crc32(ids[at[i] : at[i] + cnt[i]].astype("<u4").tobytes())
            order = np.lexsort((tie, doc))
            begin, held, size = int(base[bucket]), [], 0
            for k, i in enumerate(order):
                held.append(i)
                size += int(cnt[i])
                if size >= BLOCK or k == len(order) - 1:
                    part = np.concatenate([ids[at[j] : at[j] + cnt[j]] for j in held])
                    block = encode_block(part.astype(np.int64), table, begin, doc[held], cnt[held])
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([begin], pa.int64()), pa.array([size], pa.int64()), pa.array([block], pa.binary())], ["bucket", "start", "n_ids", "block"])
                    begin, held, size = begin + size, [], 0

    blocks = staged.select("bucket", "ids").repartitionById(ranges, F.col("bucket")).mapInArrow(pack, "bucket int, start long, n_ids long, block binary")
    blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
    scratch.drop("staged")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of each document, decoded from the files.

    ``ids`` are little-endian unsigned 32-bit integers. The table has one row per symbol of a vocabulary.
    """
    pairs = spark.read.schema("symbol int, freq int").parquet(f"{folder}/table").collect()
    table = Table(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                start, ids, doc, cnt = decode_block(block.as_py(), table)
                raw, at = ids.astype("<u4").tobytes(), np.cumsum(cnt) - cnt
                parts = [raw[4 * a : 4 * (a + c)] for a, c in zip(at, cnt, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, mask=doc == NO_ID), pa.array(at + start), pa.array(cnt), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    blocks = spark.read.schema("block binary").parquet(f"{folder}/blocks")
    return blocks.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
