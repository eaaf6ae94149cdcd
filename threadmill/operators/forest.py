"""Forests given by pointers upwards: roots by pointer doubling, cycles, and all rows above.

Tables are ``node, up``; ``up`` names a node or is null at a root. Every round doubles how far pointers reach twice and is then written, so a depth
of d takes half the logarithm of d rounds, and what an executor held can be read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage_table


def _doubled(state: DataFrame) -> DataFrame:
    """Each open pointer goes on to where the node it is at points to."""
    there = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("open").alias("next_open"))
    moved = state.where("open").join(there, "at").select("node", F.col("next").alias("at"), F.col("next_open").alias("open"))
    return state.where("NOT open").unionByName(moved)


def roots(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, root`` of all nodes that have one, and ``node, at`` of those that lead into a cycle, with a node on it."""
    state = stage_table(pointers.select("node", F.coalesce("up", "node").alias("at"), F.col("up").isNotNull().alias("open")), "pointers")
    reach, nodes = 1, None
    while not state.where("open").isEmpty():
        nodes = state.count() if nodes is None else nodes
        if reach > nodes:  # further than any path without a cycle is long
            break
        state = stage_table(_doubled(_doubled(state)), "pointers")
        reach *= 4
    return state.where("NOT open").select("node", F.col("at").alias("root")), state.where("open").select("node", "at")


def cycle_entries(pointers: DataFrame, turning: DataFrame) -> DataFrame:
    """``node, last`` of the nodes that lead into a cycle: the node of the cycle that points to where the node comes upon it."""
    on = stage_table(turning.select(F.col("at").alias("node")).distinct(), "on-cycles")
    own = pointers.join(turning.select("node"), "node", "left_semi")
    before = stage_table(own.join(on, "node", "left_semi").select(F.col("up").alias("root"), F.col("node").alias("last")), "before")
    cut = own.join(on.withColumn("on", F.lit(True)), "node", "left").select("node", F.when(F.col("on").isNull(), F.col("up")).alias("up"))
    return roots(cut)[0].join(before, "root").select("node", "last")


def closure(pointers: DataFrame) -> DataFrame:
    """``node, up`` of every pair of a node and another one above it, cycles included; as many rows as there are such pairs."""
    pairs = stage_table(pointers.select("node", "up").distinct(), "above")
    n = pairs.count()
    while n:
        further = pairs.join(pairs.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").where("next <> node").select("node", F.col("next").alias("up"))
        pairs = stage_table(pairs.unionByName(further).distinct(), "above")
        before, n = n, pairs.count()
        if n == before:
            break
    return pairs
