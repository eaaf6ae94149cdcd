"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that a link ``a, b`` names; ``root`` is the smallest node it reaches.

    Links are distinct or not, in either direction; links of a node to itself and nulls are left out. Every round is
    written to the shared folder. The minima are written before they are joined, so that both sides of that join are
    plain shuffles and a node with very many links can be split over tasks. Rounds end with stars: a node that has one link up has
    none down, which further rounds would leave as it is.
    """
    edges = scratch.put(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    for k in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"large-{k}")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.put(large.where("a <> b").distinct(), f"edges-{k}-large")
        least = scratch.put(large.groupBy("a").agg(F.min("b").alias("m")), f"small-{k}")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges_now = scratch.put(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"edges-{k}")
        for table in (f"edges-{k - 1}", f"large-{k}", f"edges-{k}-large", f"small-{k}"):
            scratch.drop(table)
        edges = edges_now
        up = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = up.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"links have not settled after {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
