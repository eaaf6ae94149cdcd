"""SimHash near-duplicate groups.

Each document gets a 64-bit fingerprint of its word shingles. Fingerprints that differ in at most ``radius`` bits are
linked: the 64 bits are cut into more blocks than that, of which two such fingerprints share at least
``blocks - radius`` whole ones, so joining on every choice of so many blocks finds every link; candidates are then
verified by their Hamming distance. Only distinct fingerprints are compared, a bucket of many is compared in bounded units (pairs of
chunks), and each unit hands on a spanning forest of its links rather than the pairs.

Null texts count as empty; a text without words has fingerprint zero and is linked like any other; shorter
texts than a shingle are one shingle; repeated rows and ties stay in one group; null ids are grouped but never name a
group that has another id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .textblocks import Words, bit_counts, slices

CHUNK = 2048
SMALL = 16
SALTS = 64


def fingerprints_of(data: np.ndarray, offs: np.ndarray, shingle: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per document."""
    words = Words(data, offs)
    joined, start, end = words.joined(lower=True)
    n = words.counts()
    shingles = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.repeat(words.doc[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    last = first + np.repeat(np.minimum(n, shingle) - 1, shingles)
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    pairs = zip(start[first].tolist(), end[last].tolist(), strict=True)
    h = np.fromiter((digest(text[a:b], 42) for a, b in pairs), np.uint64, len(first))
    bits = (2 * bit_counts(h, shingles) > shingles[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprints_of(data, offs, shingle).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def forest(fp: np.ndarray, radius: int, other: np.ndarray | None = None, loose: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(child, parent)`` of a spanning forest of the links among fingerprints (and a second one of each)."""
    left, child, parent = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= radius
            if other is not None:
                near &= np.bitwise_count(other[left] ^ other[at]) <= loose
            if near.any():
                found = left[near]
                child.append(found)
                parent.append(np.full(len(found), at))
                queue += found.tolist()
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(child), np.concatenate(parent)) if child else (none, none)


def linked(radius: int, loose: int = 64):
    """Links of the units of one partition, which is sorted by unit; a unit may span batches.

    Rows are ``unit, fp`` or ``unit, fp, other, node``; links are of nodes (of fingerprints, where there are none).
    """

    def links(unit: np.ndarray, fp: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
        other, node = more or (None, fp)
        cut = np.flatnonzero(unit[1:] != unit[:-1]) + 1
        start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(unit)]])
        size = np.repeat(end - start, end - start)
        a, b = [], []
        for k in range(1, min(SMALL, int(size.max()))):  # small units: every row with the k-th row after it
            near = np.flatnonzero((unit[k:] == unit[:-k]) & (size[k:] <= SMALL))
            near = near[np.bitwise_count(fp[near] ^ fp[near + k]) <= radius]
            if other is not None:
                near = near[np.bitwise_count(other[near] ^ other[near + k]) <= loose]
            a.append(node[near])
            b.append(node[near + k])
        large = end - start > SMALL
        for s, e in zip(start[large], end[large], strict=True):
            child, parent = forest(fp[s:e], radius, None if other is None else other[s:e], loose)
            a.append(node[s:e][child])
            b.append(node[s:e][parent])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [np.asarray(c).view(np.uint64) for c in batch.columns]
            now[0] = now[0].view(np.int64)
            held = now if held is None else [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if done:
                yield links(*[c[:done] for c in held])
                held = [c[done:] for c in held]
        if held is not None and len(held[0]):
            yield links(*held)
        held = batch = now = None
        pa.default_memory_pool().release_unused()  # the worker stays for later stages

    return run


def block_masks(radius: int, blocks: int) -> list[int]:
    """A mask for each choice of ``blocks - radius`` out of the blocks of the 64 bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(each, blocks - radius)]


def _keys(fp: Column, radius: int, blocks: int, salt: int = 0) -> list[Column]:
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.xxhash64(F.lit(i + salt), fp.bitwiseAND(F.lit(signed(m)).cast("long"))) for i, m in enumerate(block_masks(radius, blocks))]


def in_units(buckets: DataFrame, rest: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Rows ``unit, *rest`` from rows ``bucket, *rest``, sorted by unit. A large bucket is cut into chunks; every pair of chunks is a unit.

    With ``scratch`` the counts are written before they are joined: few of them are broadcast by their size, and with many both sides
    of the join are plain shuffles, in which a crowded bucket can be split over tasks.
    """
    many = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    many = many if scratch is None else scratch.put(many, "shared-buckets")
    rows = buckets.join(many, "bucket")
    chunks = F.ceil(F.col("n") / CHUNK)
    own = F.pmod(F.xxhash64(rest[-1], F.lit(1)), chunks)
    rows = rows.select("bucket", *rest, own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other_chunk"))
    unit = F.xxhash64("bucket", F.least("own", "other_chunk"), F.greatest("own", "other_chunk"))
    return rows.select(unit.alias("unit"), *rest).repartition(F.col("unit")).sortWithinPartitions("unit")


def near_links(fps: DataFrame, scratch: Scratch, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints (column ``fp``) within the radius."""
    buckets = fps.select("fp", F.explode(F.array(*_keys(F.col("fp"), radius, blocks))).alias("bucket"))
    return in_units(buckets, ["fp"], scratch).mapInArrow(linked(radius), "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = fingerprints(docs, shingle, id_col, text_col)
    rows = scratch.put(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "rows")
    parts = rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("least_id"))
    nodes = scratch.put(parts.groupBy("fp").agg(F.min("least_id").alias("least_id"), F.collect_set("salt").alias("salts")), "nodes")
    links = scratch.put(near_links(nodes.select("fp"), scratch, radius, blocks), "links")
    roots = scratch.put(connected_components(links, scratch), "roots")
    member = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", "salts", F.coalesce("root", "fp").alias("root"))
    member = scratch.put(member, "members")
    names = scratch.put(member.groupBy("root").agg(F.min("least_id").alias("component_id")), "names")
    cells = scratch.put(member.join(names, "root").select("fp", "component_id", F.explode("salts").alias("salt")), "cells")
    return rows.join(cells, ["fp", "salt"]).select("doc_id", "fp", "component_id")
