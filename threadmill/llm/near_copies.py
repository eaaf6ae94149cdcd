"""Near copies: texts whose five-word shingles are alike, found under MinHash bands, sifted by SimHash and verified exactly.

Texts are compared by their sets of five-word shingles (words as in ``textblocks``, ASCII letters lower-cased); two are linked
if the shared shingles are at least 0.8 of all shingles of both. Texts of fewer words than a shingle are linked only
to texts of the same words. Words and shingles are compared by 64 bits of hash, whole word sequences by 128 bits.

Texts whose SimHash fingerprints differ in 3 bits at most are candidates by the block keys of operator 10. At a similarity of 0.8 fingerprints
differ in some 9.5 of 64 bits, too many for such blocks alone; so texts meet on bands of ``ROWS`` least hashes, too: of ``BANDS`` bands a pair of similarity s shares one with a probability of 1 - (1 - s**8)**24 (0.988 at 0.8), whatever
the edit was. Texts that share a band and whose fingerprints of the same shingles are within ``LOOSE`` bits are candidates.
Texts that such links connect form a candidate group; inside it all pairs are compared on the whole sets, so a pair is missed only
if no chain of candidates joins it. Groups are compared in units of bounded size (pairs of chunks). In a group of several chunks the text nearest
to the group's middle is compared with all others first, and then only those that are not linked to it are compared with the rest.

Null texts count as empty; texts without words are equal; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .simhash_dedup import in_units, linked, near_links
from .textblocks import PlaceHash, Words, bit_counts, column_bytes, mix64, slices

SHINGLE = 5
#: Least similarity as a fraction.
OVER, UNDER = 4, 5
BANDS, ROWS, LOOSE = 24, 8, 20
#: Shingles and texts of a chunk.
SHINGLES, MEMBERS = 60_000, 256
_WORD, _STEP = PlaceHash(29), np.uint64(0x9E3779B97F4A7C15)
_TURNS, _FLIPS = np.random.default_rng(29).integers(0, 1 << 32, (2, BANDS, ROWS), dtype=np.uint32)
_TURNS |= np.uint32(1)


def _chained(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` consecutive word hashes from each place."""
    out = np.full(len(first), size, np.uint64)
    for k in range(size):
        out = mix64((out ^ h[first + k]) + _STEP)
    return out


def _places(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each run of ``size`` words, and the number of runs of each document."""
    runs = np.maximum(words.counts() - size + 1, 0)
    return np.repeat(words.doc[:-1] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum()), runs


def _distinct(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, ascending, and how many."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(counts))


def _majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.packbits((2 * bit_counts(h, counts) > counts[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel()


def bands(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A key for each band of each document that has shingles: of its least values in ``ROWS`` orders of 32 bits of the hashes."""
    counts = counts[counts > 0]
    ends = np.cumsum(counts)
    out, low, at = np.zeros((len(counts), BANDS), np.uint64), (h >> np.uint64(32)).astype(np.uint32), 0
    while at < len(counts):  # arrays that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 15), "right")))
        own, first = low[ends[at] - counts[at] : ends[to - 1]], np.cumsum(counts[at:to]) - counts[at:to]
        for b in range(BANDS):
            key = np.full(to - at, b, np.uint64)
            for r in range(ROWS):
                key = mix64((key ^ np.minimum.reduceat((own ^ _FLIPS[b, r]) * _TURNS[b, r], first)) + _STEP)
            out[at:to, b] = key
        at = to
    return out


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and how many."""
    words = Words(data, offs)
    joined, start, end = words.joined(lower=True)
    first, runs = _places(words, SHINGLE)
    return _distinct(_chained(_WORD.of(joined, start, end), first, SHINGLE), runs)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row a digest of its words (two halves), the number of its shingles, its fingerprint and its bands."""
    for rows, data, offs in slices(batches):
        words = Words(data, offs)
        joined, start, end = words.joined(lower=True)
        text = joined.tobytes()
        places = zip(words.doc[:-1].tolist(), words.counts().tolist(), strict=True)
        digest = b"".join([xxhash.xxh3_128_digest(text[start[a] : end[a + k - 1]] if k else b"") for a, k in places])
        halves = np.frombuffer(digest, np.int64).reshape(-1, 2)
        first, runs = _places(words, SHINGLE)
        own, n = _distinct(_chained(_WORD.of(joined, start, end), first, SHINGLE), runs)
        keys = bands(own, n).view(np.int64)
        at = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
        columns = [*halves.T.copy(), np.maximum(words.counts() - SHINGLE + 1, 0).astype(np.int32), _majority(own, n)]
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, columns), lists], ["row_key", "doc_id", "d0", "d1", "n", "fp", "bands"])
    pa.default_memory_pool().release_unused()  # the worker stays for later stages


def candidate_links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links ``a, b`` that connect all nodes (``node, fp, bands``) that share a band and are within ``LOOSE`` bits."""
    buckets = nodes.select(F.explode("bands").alias("bucket"), "fp", F.col("fp").alias("other"), "node")
    return in_units(buckets, ["fp", "other", "node"], scratch).mapInArrow(linked(LOOSE), "a long, b long").distinct()


def simhash_links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links ``a, b`` that connect all nodes (``node, fp``) whose fingerprints differ in 3 bits at most, by the block keys of operator 10."""
    first = scratch.put(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    equal = nodes.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = scratch.put(near_links(first.select("fp"), scratch).distinct(), "near-fingerprints")
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    near = near.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return equal.unionByName(near)


def _forest(alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(child, parent)`` of a spanning forest of a symmetric table of links."""
    left, child, parent = np.ones(len(alike), bool), [], []
    for root in range(len(alike)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            at = queue.pop()
            found = np.flatnonzero(alike[at] & left)
            left[found] = False
            child.append(found)
            parent.append(np.full(len(found), at))
            queue += found.tolist()
    return np.concatenate(child), np.concatenate(parent)


def _compared(side: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a unit: among all its texts or, where it has two sides, across them."""
    doc = np.repeat(np.arange(len(n)), n)
    value, column = np.unique(h, return_inverse=True)
    many = np.bincount(column) > 1
    number = np.cumsum(many) - 1
    keep = many[column]
    doc, column = doc[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    shared = np.zeros((len(n), len(n)), np.float32)
    for at in range(0, int(many.sum()), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        table = np.zeros((len(n), min(4096, int(many.sum()) - at)), np.float32)
        table[doc[a:b], column[a:b] - at] = 1
        shared += table @ table.T
    alike = (OVER + UNDER) * shared >= OVER * (n[:, None] + n[None, :])
    np.fill_diagonal(alike, False)
    if side.any():
        alike &= side[:, None] != side[None, :]
    return _forest(alike)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of the units of one partition, which is sorted by unit; a unit may span batches."""

    def links(units: np.ndarray, side: np.ndarray, node: np.ndarray, text: pa.Array) -> Iterator[pa.RecordBatch]:
        h, n = shingle_sets(*column_bytes(text))
        at = np.concatenate([[0], np.cumsum(n)])
        cut = np.concatenate([[0], np.flatnonzero(units[1:] != units[:-1]) + 1, [len(units)]])
        for s, e in zip(cut, cut[1:], strict=False):
            if e - s > 1:
                child, parent = _compared(side[s:e], h[at[s] : at[e]], n[s:e])
                yield pa.RecordBatch.from_arrays([pa.array(node[s:e][child]), pa.array(node[s:e][parent])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for rows, _, _ in slices(iter([batch])):
            units = np.asarray(rows.column(0))
            last = int(np.searchsorted(units, units[-1]))  # the last unit of a slice may go on
            if held and np.asarray(held[-1].column(0))[-1] != units[-1]:
                done = pa.Table.from_batches([*held, rows.slice(0, last)]).combine_chunks()
                yield from links(*[done.column(i).to_numpy() for i in range(3)], done.column(3).combine_chunks())
                held = []
            elif not held and last:
                yield from links(*[np.asarray(rows.column(i))[:last] for i in range(3)], rows.column(3).slice(0, last))
            held.append(rows.slice(last) if not held else rows)
    if held:
        done = pa.Table.from_batches(held).combine_chunks()
        yield from links(*[done.column(i).to_numpy() for i in range(3)], done.column(3).combine_chunks())
        del done, held
    pa.default_memory_pool().release_unused()  # the worker stays for later stages


def _links(units: DataFrame) -> DataFrame:
    """Links ``a, b`` from rows ``unit, side, node, text``."""
    rows = units.select("unit", F.col("side").cast("int").alias("side"), "node", "text")
    return rows.repartition(F.col("unit")).sortWithinPartitions("unit").mapInArrow(_alike, "a long, b long")


def _chunk(node: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(1)), chunks)


def _chunks(n: Column, rows: Column) -> Column:
    return F.greatest(F.ceil(n / SHINGLES), F.ceil(rows / MEMBERS))


def verified(members: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links that connect all texts of each candidate group that are alike.

    ``members``: ``root, node, n`` (shingles) and ``fp``, a fingerprint; ``texts``: ``node, text``.
    """
    groups = members.groupBy("root").agg(F.sum("n").alias("shingles"), F.count("*").alias("texts"))
    groups = groups.where("texts > 1").select("root", _chunks(F.col("shingles"), F.col("texts")).alias("chunks"))
    own = scratch.put(members.join(groups, "root").join(texts, "node").select("root", "node", "n", "fp", "chunks", "text"), "candidates")
    side = lambda k: F.lit(k).alias("side")
    small = own.where("chunks = 1").select(F.col("root").alias("unit"), side(0), "node", "text")
    links = scratch.put(_links(small), "links-small")

    # Groups of several chunks: the text in the middle against each chunk.
    large = own.where("chunks > 1").withColumn("chunk", _chunk(F.col("node"), F.col("chunks")))
    bit = lambda k: F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1).cast("long"))
    votes = large.groupBy("root").agg(*[(2 * F.sum(bit(k)) > F.count("*")).alias(f"v{k}") for k in range(64)])
    middle = F.lit(0).cast("long")
    for k in range(64):
        middle = middle.bitwiseOR(F.when(F.col(f"v{k}"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    votes = votes.select("root", middle.alias("middle"))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))
    pivots = large.join(votes, "root").groupBy("root", "chunks").agg(F.min_by(F.struct("node", "text"), F.struct(far, "node")).alias("p"))
    pivots = scratch.put(pivots.select("root", "chunks", "p.node", "p.text"), "pivots")
    unit = F.xxhash64("root", F.lit(-1), "chunk").alias("unit")
    star = large.select(unit, side(1), "node", "text").join(pivots.select("node"), "node", "left_anti").select("unit", "side", "node", "text")
    star = star.unionByName(pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(unit, side(0), "node", "text"))
    star = scratch.put(_links(star), "links-star")

    # Texts that the middle is not linked to, against all of their group.
    reached = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    loose = large.join(reached, "node", "left_anti").select("root", "node", "n", "text")
    parts = loose.groupBy("root").agg(F.sum("n").alias("shingles"), F.count("*").alias("texts")).select("root", _chunks(F.col("shingles"), F.col("texts")).alias("parts"))
    parts = scratch.put(parts, "parts")
    loose = loose.join(parts, "root").withColumn("part", _chunk(F.col("node"), F.col("parts")))
    unit = F.xxhash64("root", "part", "chunk").alias("unit")
    first = loose.join(groups.where("chunks > 1"), "root").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rest = large.join(parts, "root").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = first.select(unit, side(0), "node", "text").unionByName(rest.select(unit, side(1), "node", "text"))
    more = scratch.put(_links(pairs), "links-rest")
    return links.unionByName(star).unionByName(more).where("a <> b")


def gone(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_key`` of the rows that do not stay: of each group of near copies that with the smallest id (null last), then the smallest key does.

    ``row_key`` is a column of ``docs``, a long that no two rows share and that is the same whenever it is read. The result reads tables of ``scratch``.
    """
    texts = docs.select("row_key", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.put(texts.mapInArrow(_nodes, "row_key long, doc_id long, d0 long, d1 long, n int, fp long, bands array<long>"), "rows")
    # Of rows with the same words one is a node; only nodes are compared.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "n", "fp", "bands")
    nodes = rows.groupBy("d0", "d1").agg(F.min(rank).alias("r"))
    nodes = scratch.put(nodes.select(F.col("r.row_key").alias("node"), "r.none", "r.doc_id", "r.n", "r.fp", "r.bands"), "nodes")
    some = nodes.where("n > 0")
    links = scratch.put(simhash_links(some, scratch).unionByName(candidate_links(some, scratch)), "candidate-links")
    roots = scratch.put(connected_components(links, scratch), "candidate-groups")
    members = roots.join(nodes.select("node", "n", "fp"), "node").select("root", "node", "n", "fp")
    sure = verified(members, texts.select(F.col("row_key").alias("node"), "text"), scratch)
    same = scratch.put(connected_components(sure, scratch), "groups")
    best = F.min(F.struct("none", "doc_id", "node")).alias("best")
    named = nodes.join(same, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(best)
    stay = scratch.put(named.select(F.col("best.node").alias("row_key")), "stay")
    return rows.select("row_key").join(stay, "row_key", "left_anti")
