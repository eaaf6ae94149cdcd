"""Hard negatives by exact inner products that an orthogonal rotation cuts short.

Vectors become integers, floor(256 x) of each component. Second moments that Spark sums over all rows give an orthogonal rotation whose
leading components carry most of every product. For an anchor and a row the product of the leading components is
accumulated level by level; what the rest can add is at most the product of the norms of what is left, and some slack covers
rounding. A pair is dropped as soon as that bound cannot reach the rows found so far, or the band that is asked for; pairs that
are left are verified by products of the integers themselves, so results are exact.

Two searches, each of anchor blocks against all rows in units of (anchor block, group of rows), both of bounded size: the nearest
rows of an anchor's label (rows meet anchors of their label only), then, for each of these positives, the nearest rows of other labels whose score lies
in a band below the positive's. A unit keeps some rows for each anchor and hands on only these.

Rows with a null label, a null vector, or any null or non-finite component take no part, nor do vectors so long that a product need
not fit into a long (a squared norm of 2**62 or more). Shorter vectors are filled up with zeros. Rows are told apart by where they lie, so repeated
rows, also of one id, are rows of their own; rows without an id come last among equal scores and are never anchors. An empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

ANCHORS, ROWS, CHUNK = 1024, 262_144, 4096  # a group has a chunk of rows at least
#: Shares of the components after which a bound is taken.
LEVELS = (0.25, 0.5)
NO_ID = (1 << 63) - 1
_LIMIT = float(1 << 62)


def _as_matrix(blobs: pa.Array, width: int) -> np.ndarray:
    """Integers of packed vectors, filled up with zeros."""
    raw = [np.frombuffer(b, "<i4") for b in blobs.to_pylist()]
    if raw and all(len(r) == width for r in raw):
        return np.concatenate(raw).reshape(-1, width)
    out = np.zeros((len(raw), width), np.int32)
    for i, r in enumerate(raw):
        out[i, : len(r)] = r
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, label, v, size`` of the rows ``id, label, vector`` that take part."""
    for batch in batches:
        column = batch.column(2)
        n = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        flat = column.flatten()  # leaves out what is null
        x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
        row = np.repeat(np.arange(len(n)), n)
        good = np.asarray(column.is_valid()) & np.asarray(batch.column(1).is_valid())
        good[row[~np.isfinite(x)]] = False
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.floor(256 * x)
            good &= np.bincount(row, v * v, len(n)) < _LIMIT
        v = np.where(good[row], v, 0).astype("<i4")
        ends = np.cumsum(n)
        at = np.flatnonzero(good)
        packed = [v[ends[i] - n[i] : ends[i]].tobytes() for i in at]
        kept = batch.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(packed, pa.binary()), pa.array(n[at].astype(np.int32))], ["id", "label", "v", "size"])


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Orthogonal directions by falling second moment, as columns; what reaches the driver is one number for each pair of components."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _as_matrix(batch.column(0), width).astype(np.float64)
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            x /= np.maximum(norm, 1)  # directions alone, so that a few long vectors do not decide
            total += x.T @ x
        at = np.arange(width)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, width), pa.int32()), pa.array(np.tile(at, width), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    sums = rows.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((width, width))
    for i, j, s in sums:
        m[i, j] = s
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


class Side:
    """Vectors of one side of a search: integers, rotated components and what is left of the norm after each level."""

    def __init__(self, v: np.ndarray, turn: np.ndarray, cuts: list[int]):
        self.v = v.astype(np.int64)
        y = v.astype(np.float64) @ turn
        self.y = y.astype(np.float32)
        self.norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        self.left = np.stack([np.sqrt((y[:, c:] ** 2).sum(1)) for c in cuts]) if len(v) else np.zeros((len(cuts), 0))


def survivors(a: Side, b: Side, cuts: list[int], least: np.ndarray, most: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of allowed rows whose product may lie between ``least`` and ``most`` of the anchor, with their exact products."""
    slack = (a.y.shape[1] + 64) * 2.0**-23
    first = cuts[0] if cuts else 0
    part = a.y[:, :first] @ b.y[:, :first].T
    room = (a.left[0][:, None] * b.left[0][None, :] if cuts else 0) + slack * (a.norm[:, None] * b.norm[None, :]) + 1e-3
    i, j = np.nonzero(allowed & (part + room >= least[:, None]) & (part - room <= most[:, None]))
    part = part[i, j].astype(np.float64)
    for k in range(1, len(cuts)):
        part += np.einsum("nd,nd->n", a.y[i, cuts[k - 1] : cuts[k]], b.y[j, cuts[k - 1] : cuts[k]])
        room = a.left[k][i] * b.left[k][j] + slack * a.norm[i] * b.norm[j] + 1e-3
        keep = (part + room >= least[i]) & (part - room <= most[i])
        i, j, part = i[keep], j[keep], part[keep]
    score = np.einsum("nd,nd->n", a.v[i], b.v[j])
    keep = (score >= least[i]) & (score <= most[i])
    return i[keep], j[keep], score[keep]


def _ranked(slot: np.ndarray, score: np.ndarray, ident: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each slot: by falling score, then id, then key."""
    order = np.lexsort((key, ident, -score, slot))
    s = slot[order]
    begin = np.flatnonzero(np.diff(s, prepend=-1))
    rank = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    return order[rank < k]


class Unit:
    """One anchor block and the best rows so far in each of its slots: one slot an anchor, or one for each of its bands."""

    def __init__(self, anchors: pa.RecordBatch, turn: np.ndarray, cuts: list[int], k: int, bands: bool):
        self.key, self.label = (np.asarray(anchors.column(c)) for c in ("key", "label"))
        self.side, self.turn, self.cuts, self.k, self.bands = Side(_as_matrix(anchors.column("v"), len(turn)), turn, cuts), turn, cuts, k, bands
        n = len(self.key)
        lo, hi = (anchors.column(c).to_pylist() if bands else [[np.iinfo(np.int64).min + 1 if c == "lo" else NO_ID]] * n for c in ("lo", "hi"))
        size = np.array([len(x) for x in lo], np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.owner = np.repeat(np.arange(n), size)
        self.rank = np.arange(len(self.owner)) - self.first[self.owner]
        self.lo, self.hi = (np.array([v for own in x for v in own], np.int64) for x in (lo, hi))
        self.least = self.lo.copy()  # the score below which a slot takes no more
        self.found = [np.zeros(0, np.int64) for _ in range(4)]  # slot, score, id, key

    def take(self, rows: pa.RecordBatch) -> None:
        ident, key, label = (np.asarray(rows.column(c)) for c in ("id", "key", "label"))
        other = Side(_as_matrix(rows.column("v"), len(self.turn)), self.turn, self.cuts)
        same = self.label[:, None] == label[None, :]
        allowed = ~same if self.bands else same & (self.key[:, None] != key[None, :])
        if not len(self.owner):
            return
        least, most = np.minimum.reduceat(self.least, self.first[:-1]), np.maximum.reduceat(self.hi, self.first[:-1])
        i, j, score = survivors(self.side, other, self.cuts, least, most, allowed)
        each = np.diff(self.first)[i]
        slot = np.repeat(self.first[i] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        score, j = np.repeat(score, each), np.repeat(j, each)
        keep = (score >= self.least[slot]) & (score <= self.hi[slot])
        more = (slot[keep], score[keep], ident[j[keep]], key[j[keep]])
        found = [np.concatenate(x) for x in zip(self.found, more, strict=True)]
        best = _ranked(*found, self.k)
        self.found = [x[best] for x in found]
        full = np.bincount(self.found[0], minlength=len(self.owner)) == self.k
        low = self.lo.copy()
        worst = np.full(len(low), NO_ID)
        np.minimum.at(worst, self.found[0], self.found[1])
        self.least = np.where(full, np.maximum(low, worst), low)

    def rows(self) -> pa.RecordBatch:
        slot, score, ident, key = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.key[self.owner[slot]]), pa.array(self.rank[slot].astype(np.int32)), pa.array(score), pa.array(ident), pa.array(key)], ["anchor", "slot", "score", "id", "key"])


_FOUND = "anchor long, slot int, score long, id long, key long"


def _searched(turn: np.ndarray, cuts: list[int], k: int, bands: bool):
    """Rows come sorted by unit, a unit's anchors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, anchors, unit = None, [], None

        def begun() -> Unit | None:
            return Unit(pa.Table.from_batches(anchors).combine_chunks().to_batches()[0], turn, cuts, k, bands) if anchors else None

        for batch in batches:
            units, part, side = (np.asarray(batch.column(c)) for c in ("unit", "part", "side"))
            cut = np.flatnonzero((np.diff(units) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            for s, e in zip([0, *cut], [*cut, len(units)], strict=True):
                if e == s:
                    continue
                if (units[s], part[s]) != current:
                    if unit is not None:
                        yield unit.rows()
                    current, anchors, unit = (units[s], part[s]), [], None
                if side[s] == 0:
                    anchors.append(batch.slice(s, e - s))
                    continue
                unit = unit or begun()
                for at in range(s, e, CHUNK) if unit else ():
                    unit.take(batch.slice(at, min(CHUNK, e - at)))
        if unit is not None:
            yield unit.rows()

    return run


def _units(anchors: DataFrame, rows: DataFrame, by_label: bool, groups: int, blocks: int) -> DataFrame:
    """Rows ``unit, part, side, id, key, label, v, lo, hi``: every anchor block with every group of rows (of the same label).

    A row's copies are one for each anchor block, an anchor's one for each group of rows.
    """
    spread: Column = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(groups))
    block: Column = F.pmod(F.xxhash64("key", F.lit(6)), F.lit(blocks))
    count = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.select(block.alias("block"), F.lit(0).alias("side"), "id", "key", "label", "v", "lo", "hi", count(groups).alias("group"))
    none = F.lit(None).cast("array<long>")
    b = rows.select(spread.alias("group"), F.lit(1).alias("side"), "id", "key", "label", "v", none.alias("lo"), none.alias("hi"), count(blocks).alias("block"))
    unit, part = F.col("block") * F.lit(groups).cast("long") + F.col("group"), F.col("label") if by_label else F.lit(0).cast("long")
    columns = [unit.alias("unit"), part.alias("part"), "side", "id", "key", "label", "v", "lo", "hi"]
    both = a.select(*columns).unionByName(b.select(*columns))
    return both.repartition(F.col("unit"), F.col("part")).sortWithinPartitions("unit", "part", "side")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each slot over all units, with ``place`` from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "key")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95),
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchors_a_block: int = ANCHORS, rows_a_group: int = ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is a condition on ``id``. For each anchor and each of its first ``positives`` rows of the same label: the first ``negatives`` rows
    of other labels whose score is between the two percentages ``band`` of the positive's score.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.mapInArrow(_whole, "id long, label long, v binary, size int")
    rows = scratch.put(rows.withColumn("key", F.monotonically_increasing_id()).withColumn("anchor", F.coalesce(anchor, F.lit(False))), "rows")
    width, n, asked = rows.agg(F.max("size"), F.count("*"), F.count_if("anchor")).first()
    width = width or 0
    turn = rotation(rows, width) if width else np.zeros((0, 0))
    cuts = sorted({max(1, int(width * share)) for share in LEVELS} | {width}) if width else []
    blocks = max(1, -(-asked // anchors_a_block))
    groups = max(-(-n // rows_a_group), min(-(-n // CHUNK), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)), 1)
    rows = rows.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    anchors = rows.where("anchor").select("id", "key", "label", "v")
    none = F.lit(None).cast("array<long>")
    near = _units(anchors.withColumns({"lo": none, "hi": none}), rows, True, groups, blocks).mapInArrow(_searched(turn, cuts, positives, False), _FOUND)
    near = scratch.put(_best(near, positives).select("anchor", "place", "score", "id"), "positives")
    # 50 p <= 100 n <= 95 p in whole numbers: n from the quotient rounded up to the one rounded down.
    q, r = F.expr("(score - pmod(score, 100L)) div 100"), F.expr("pmod(score, 100L)")
    low, high = q * band[0] + F.floor((r * band[0] + 99) / 100), q * band[1] + F.floor(r * band[1] / 100)
    bands = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", low.alias("lo"), high.alias("hi")))).alias("b"))
    bands = bands.select(F.col("anchor").alias("key"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))
    far = _units(anchors.join(bands, "key"), rows, False, groups, blocks).mapInArrow(_searched(turn, cuts, negatives, True), _FOUND)
    far = _best(far, negatives).select("anchor", (F.col("slot") + 1).alias("place"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = near.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(far, ["anchor", "place"])
    found = found.join(anchors.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.select("anchor_id", named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score", "negative_score")
