"""A partitioned index of unit vectors with exact bounds.

Vectors are assigned to the nearest of some centroids; the index keeps with each part the greatest angle between its centroid and a
member. By the triangle inequality of angles no member can be nearer to an asked vector than the angle between that and the centroid less the
part's own, so parts that cannot reach the best rows found so far are skipped and the result stays exact.
Parts are stored in slices of a bounded number of rows; parts of equal vectors, however many, are many slices.

Rows are ``interaction_id, vector``, normalised here; ids are unique. The zero vector scores 0 and lies in a part of its own (-1). An
empty index has no result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contracts
from ..plans.staging import stage_table
from .kmeans import lloyd, packed
from .vectors import normalized

#: Rows of a slice; centroids at most (they are sent to every task); rounds that move them.
SLICE, PARTS, ROUNDS = 2048, 2048, 4
_SLACK = 1e-9


@dataclass
class VectorIndex:
    spark: SparkSession
    folder: str
    dim: int
    model: str

    def rows(self) -> DataFrame:
        """``part, slice, interaction_id, vector``."""
        return self.spark.read.schema("interaction_id long, vector array<double>, slice int, part int").parquet(f"{self.folder}/docs")

    def parts(self) -> DataFrame:
        """``part, rows, slices, angle, centre``."""
        return self.spark.read.parquet(f"{self.folder}/parts")


def build(vectors: DataFrame, folder: str, model: str, key: str = "interaction_id", rows_a_part: int = 256) -> VectorIndex:
    """Write the index of ``vectors`` (``key, vector``) in parts of about ``rows_a_part`` rows, more where ``PARTS`` do not suffice."""
    spark = vectors.sparkSession
    data = stage_table(normalized(vectors.select(F.col(key).cast("long").alias("interaction_id"), "vector")), "unit-vectors")
    contracts.unique(data, "interaction_id", "interaction_id")
    n, dim, least = data.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.min(F.size("vector")), F.lit(0))).first()
    if dim != least:
        raise contracts.ContractError("the vectors of an index have one length")
    k = max(1, min(PARTS, -(-n // rows_a_part)))
    start = data.orderBy(F.xxhash64("interaction_id"), "interaction_id").limit(k).select("vector").collect()
    centres = np.array([r[0] for r in start], np.float64).reshape(len(start), dim)
    if len(centres) > 1:
        centres = lloyd(data.select("vector"), centres[None], ROUNDS).centres[0]
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = np.where(norm > 0, centres / np.maximum(norm, 1e-300), np.eye(1, dim)) if dim else centres

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = packed(b["vector"], dim)
            part, angle = np.full(len(b), -1, np.int32), np.zeros(len(b))
            some = np.flatnonzero(np.abs(v).max(axis=1, initial=0) > 0)
            if len(some):
                near = v[some] @ centres.T
                part[some] = near.argmax(axis=1)
                angle[some] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pd.DataFrame({"interaction_id": b["interaction_id"], "vector": b["vector"], "part": part, "angle": angle})

    placed = stage_table(data.mapInPandas(assign, "interaction_id long, vector array<double>, part int, angle double"), "assigned")
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"), F.max("angle").alias("angle")).withColumn("slices", F.ceil(F.col("rows") / SLICE).cast("int"))
    named = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)] + [(-1, [0.0] * dim)], "part int, centre array<double>")
    sizes = stage_table(sizes.join(F.broadcast(named), "part"), "part-sizes")  # PARTS rows at most
    sizes.write.mode("overwrite").parquet(f"{folder}/parts")
    cut = placed.join(F.broadcast(sizes.select("part", "slices")), "part").withColumn("slice", F.pmod(F.xxhash64("interaction_id"), F.col("slices")).cast("int"))
    out = cut.select("interaction_id", "vector", "slice", "part").repartition("part", "slice").sortWithinPartitions("part", "slice")
    out.write.mode("overwrite").parquet(f"{folder}/docs")
    meta = json.dumps({"index_version": 2, "embedding_model": model, "embedding_dim": dim})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
    return VectorIndex(spark, folder, dim, model)


def opened(spark: SparkSession, folder: str, model: str | None = None) -> VectorIndex:
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    if meta["index_version"] != 2 or not meta["embedding_model"]:
        raise contracts.ContractError(f"{folder} is not an index of version 2")
    if model is not None and model != meta["embedding_model"]:
        raise contracts.ContractError(f"{folder} is an index of {meta['embedding_model']}, not of {model}")
    return VectorIndex(spark, folder, meta["embedding_dim"], meta["embedding_model"])


def bounds(index: VectorIndex, asked: DataFrame) -> DataFrame:
    """``asked_id, part, rows, bound``: what a member of the part can score at most with a unit vector of ``asked``."""
    parts = index.parts().orderBy("part").collect()  # PARTS at most
    dim = index.dim
    centres = np.array([r["centre"] for r in parts], np.float64).reshape(len(parts), dim)
    number, rows, angle = np.array([r["part"] for r in parts], np.int32), np.array([r["rows"] for r in parts], np.int64), np.array([r["angle"] for r in parts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                own = b.iloc[at : at + 256]
                q = packed(own["vector"], dim)
                apart = np.arccos(np.clip(q @ centres.T, -1, 1))
                best = np.cos(np.maximum(apart - angle[None, :] - 1e-7, 0))  # arccos is right to some 1e-8 near 0
                best = np.where((number[None, :] < 0) | (np.abs(q).max(axis=1, initial=0) == 0)[:, None], 0.0, best)
                yield pd.DataFrame({"asked_id": np.repeat(own["asked_id"].to_numpy(), len(number)), "part": np.tile(number, len(own)), "rows": np.tile(rows, len(own)), "bound": best.ravel()})

    if not parts:
        return index.spark.createDataFrame([], "asked_id long, part int, rows long, bound double")
    return asked.select(F.col("asked_id").cast("long").alias("asked_id"), "vector").mapInPandas(run, "asked_id long, part int, rows long, bound double")


def _dots(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products summed component by component, so that equal vectors score alike wherever they lie."""
    out = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        out += rows[:, j] * q[j]
    return out


def _scored(index: VectorIndex, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``asked_id, interaction_id, score``: the best ``k`` of each slice of the parts of ``pairs`` (``asked_id, part``)."""
    slices = F.broadcast(index.parts().select("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")))  # SLICE rows each
    wanted = pairs.select("asked_id", "part").join(asked, "asked_id").join(slices, "part").select("part", "slice", "asked_id", F.col("vector").alias("q"))

    dim = index.dim

    def best(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        v, ids = packed(rows["vector"], dim), rows["interaction_id"].to_numpy()
        for asked_id, vector in zip(own["asked_id"], own["q"], strict=True):
            q = np.asarray(vector, np.float64)
            rough = v @ q
            cut = np.partition(rough, len(rough) - k)[len(rough) - k] - _SLACK if len(rough) > k else -np.inf
            some = np.flatnonzero(rough >= cut)
            score = _dots(v[some], q)
            first = np.lexsort((ids[some], -score))[:k]
            out.append(pd.DataFrame({"asked_id": asked_id, "interaction_id": ids[some][first], "score": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"asked_id": [], "interaction_id": [], "score": []})

    both = index.rows().groupBy("part", "slice").cogroup(wanted.groupBy("part", "slice"))
    return both.applyInPandas(best, "asked_id long, interaction_id long, score double")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asked_id").orderBy(F.desc("score"), "interaction_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(index: VectorIndex, asked: DataFrame, k: int = 5) -> DataFrame:
    """``asked_id, interaction_id, score, rank`` of the best ``k`` rows for each row of ``asked`` (``asked_id, vector``); ties by id."""
    return searched(index, asked, k)[0]


def searched(index: VectorIndex, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The best rows, and the pairs ``asked_id, part`` that were scored for them."""
    if k < 1:
        raise ValueError("k must be at least 1")
    contracts.gate(asked.where(F.size("vector") != index.dim), f"vectors that are not of dimension {index.dim}", "asked_id")
    asked = stage_table(normalized(asked.select("asked_id", "vector")), "asked-vectors")
    order = Window.partitionBy("asked_id").orderBy(F.desc("bound"), "part")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = stage_table(bounds(index, asked).withColumn("first", before < k), "part-bounds")
    found = stage_table(_best(_scored(index, asked, every.where("first"), k), k), "found")
    least = found.where(F.col("rank") == k).select("asked_id", F.col("score").alias("least"))
    rest = every.where("NOT first").join(least, "asked_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK))
    rest = stage_table(rest.select("asked_id", "part"), "rest")
    more = _scored(index, asked, rest, k)
    return _best(found.drop("rank").unionByName(more), k), every.where("first").select("asked_id", "part").unionByName(rest)


def scores_of(index: VectorIndex, asked: DataFrame, pairs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """``asked_id, interaction_id, score`` of given pairs."""
    from .vectors import dot

    rows = index.rows() if vectors is None else vectors
    own = normalized(asked.select("asked_id", "vector")).withColumnRenamed("vector", "q")
    found = pairs.select("asked_id", "interaction_id").distinct().join(rows.select("interaction_id", "vector"), "interaction_id").join(own, "asked_id")
    return found.select("asked_id", "interaction_id", dot(F.col("vector"), F.col("q")).alias("score"))
