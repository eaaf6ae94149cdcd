"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words (its weight's share of all words, capped at a multiple of what it has,
the excess shared again by weight). Every document of a source then expects ``target / source_size`` copies;
the expected copies are summed along the source, one random offset is added, and a document is emitted once for
each integer boundary that its own stretch crosses. Documents are laid out by size, so that what rounding takes
from one document it gives to one of nearly the same size; and of ``OFFSETS`` offsets, spaced evenly from a random one, a
source takes that which brings its words nearest to the target.

The running sum of a hot source is never formed in one task: ranks come from counts per (source, size, salt).

Null texts have size 0; null sources are a source of their own, last in the order; sources without words have
target 0; an empty table gives no rows; equal ids are told apart only by their order; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

OFFSETS = 16
WORDS = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from rows ``source, source_size`` (one per source).

    Sources take the weights in turn, by code point. The level at which capped shares add up to the whole is
    found in one pass: with sources sorted by cap per weight, those before the level stop at their cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    upto = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    s = s.withColumns(
        {
            "all_words": F.lit(float(share)) * F.sum("source_size").over(every),
            "capped": F.coalesce(F.sum("most").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open_weight": F.sum("weight").over(upto.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # With all earlier sources at their cap, this one stays open if its share of the rest is within its cap.
    s = s.withColumn("level", (F.col("all_words") - F.col("capped")) / F.col("open_weight"))
    s = s.withColumn("place", F.row_number().over(upto))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("place"))
    s = s.withColumn("open_level", F.min_by("level", fits).over(every))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(
        F.least(F.col("most"), F.coalesce(F.col("open_level") * F.col("weight"), F.col("most")))
    )
    return s.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    share: float = 1.0,
    cap: float = 3.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    key_col: str | None = None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every document.

    With ``key_col``, a column that no two rows share, rows are handed on with it and equal ids are ordered by it.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = [key_col] if key_col else []
    rows = scratch.put(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 3).alias("salt"),
            *key,
        ),
        "rows",
    )
    cells = scratch.put(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "cells")
    sizes = scratch.put(cells.groupBy("source", "size").agg(F.sum("n").alias("n")), "sizes")
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    steps = sizes.select("source", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("size_base"))
    within = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("source", "size", "salt", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("salt_base"))
    targets = source_targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\0"))), 256), 1, 8), 16, 10)
    targets = scratch.put(
        targets.withColumns(
            {
                "offset": offset.cast("double") / float(1 << 32),
                "rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0),
            }
        ),
        "targets",
    )
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    bases = bases.join(steps, same(bases, steps, ["source", "size"])).select(
        bases.source, bases.size, bases.salt, (F.col("size_base") + F.col("salt_base")).alias("base")
    )
    bases = bases.join(targets, same(bases, targets, ["source"])).drop(targets.source)
    bases = bases.join(cells, same(bases, cells, ["source", "size", "salt"])).drop(cells.source, cells["size"], cells.salt)
    bases = scratch.put(bases, "bases")
    whole = F.floor("rate")
    part = F.col("rate") - whole
    # Ranks of a cell are consecutive, so its boundaries are counted from its ends.
    offsets = [F.col("offset") + j / OFFSETS - F.floor(F.col("offset") + j / OFFSETS) for j in range(OFFSETS)]
    ends = [F.floor((F.col("base") + F.col("n")) * part + u) - F.floor(F.col("base") * part + u) for u in offsets]
    totals = bases.groupBy("source").agg(*[F.sum(F.col("size") * (F.col("n") * whole + e)).alias(f"t{j}") for j, e in enumerate(ends)])
    errors = [F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("error"), F.lit(j).alias("j")) for j in range(OFFSETS)]
    nearest = totals.join(targets, same(totals, targets, ["source"])).select(totals.source, F.array_min(F.array(*errors))["j"].alias("j"))
    nearest = scratch.put(nearest, "nearest")
    bases = bases.join(nearest, same(bases, nearest, ["source"])).drop(nearest.source)
    shifted = F.col("offset") + F.col("j") / OFFSETS
    bases = scratch.put(bases.withColumn("offset", shifted - F.floor(shifted)).drop("n", "j"), "chosen")
    at = Window.partitionBy("source", "size", "salt").orderBy("doc_id", *key)
    ranked = rows.withColumn("rank", F.row_number().over(at))
    k = F.col("base") + F.col("rank")
    crossed = F.floor(k * part + F.col("offset")) - F.floor((k - 1) * part + F.col("offset"))
    copies = (whole + F.least(crossed, F.lit(1))).cast("long")
    return (
        ranked.join(bases, same(ranked, bases, ["source", "size", "salt"]))
        .select("doc_id", ranked.source, ranked["size"], "source_size", "target", copies.alias("copies"), *key)
        .withColumn("taken", F.col("size") * F.col("copies"))
    )
