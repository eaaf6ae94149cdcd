"""Vectors: normalising, exact top-K, centroids, candidates, and K-means with restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contracts
from ..functions import fixed_values as V
from ..plans.staging import stage_table
from . import kmeans as clusters

#: Rows of the index and asked rows that a task compares at a time.
CHUNK_ROWS = 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length in double precision; the zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    return F.transform(F.array(d), lambda w: F.transform(w, lambda x: F.when(dot(w, w) > 0, x / F.sqrt(dot(w, w))).otherwise(x)))[0]


def normalized(rows: DataFrame, column: str = "vector") -> DataFrame:
    """As ``l2_normalize``; the norm is computed once per row."""
    n = rows.withColumn("_norm", F.sqrt(dot(F.col(column), F.col(column))))
    return n.withColumn(column, F.transform(column, lambda x: F.when(F.col("_norm") > 0, x.cast("double") / F.col("_norm")).otherwise(x.cast("double")))).drop("_norm")


def check_vectors(rows: DataFrame, dim: int) -> DataFrame:
    contracts.gate(rows.where(contracts.vector(dim).isNotNull()), "malformed vectors", "interaction_id")
    return rows


def topk(index: DataFrame, asked: list[float], k: int = V.TOP_K, key: str = "interaction_id") -> DataFrame:
    """``key, score`` of the best ``k`` by dot product; ties by key. An empty vector has no result."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if not asked:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    norm = sum(x * x for x in asked) ** 0.5 or 1.0
    q = F.array(*[F.lit(float(x) / norm) for x in asked])
    return index.select(key, dot(F.col("vector"), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def topk_batch(index: DataFrame, asked: DataFrame, k: int = V.TOP_K, key: str = "interaction_id") -> DataFrame:
    """``asked_id, key, score, rank`` for all rows of ``asked``, against the whole index; ties by key, pairs without a score last.

    Chunks of some ``CHUNK_ROWS`` rows of the index meet blocks of as many asked ones; a matrix product says which rows can be among the
    best ``k`` of the chunk, whose scores are then summed component by component. A vector that is null or has a null has no score with
    any, vectors of different lengths have none with each other.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    size = F.when(F.forall("vector", lambda x: x.isNotNull()), F.size("vector"))
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    numbered = stage_table(asked.select("asked_id", double("vector").alias("_q"), size.alias("_size")), "asked")
    rows = stage_table(index.select(key, double("vector").alias("_v"), size.alias("_size")), "vectors")
    blocks, chunks = (max(1, -(-d.count() // CHUNK_ROWS)) for d in (numbered, rows))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where("_size is not null").select("_size", dealt(key, chunks).alias("_chunk"), every(blocks).alias("_block"), key, "_v")
    right = numbered.where("_size is not null").select("_size", every(chunks).alias("_chunk"), dealt("asked_id", blocks).alias("_block"), "asked_id", "_q")
    cell = ["_size", "_chunk", "_block"]
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *numbered.schema]}

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"asked_id": [], key: [], "score": [], "_nan": []})
        v, ids, q = np.stack(a["_v"].to_numpy()), a[key].to_numpy(), np.stack(b["_q"].to_numpy())
        found = best_rows(v, ids, q, k)
        score = np.concatenate([f[1] for f in found])
        return pd.DataFrame({"asked_id": np.repeat(b["asked_id"].to_numpy(), min(k, len(v))), key: np.concatenate([f[0] for f in found]), "score": score, "_nan": np.isnan(score)})

    pairs = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(best, f"asked_id {kinds['asked_id']}, {key} {kinds[key]}, score double, _nan boolean")
    pairs = pairs.select("asked_id", key, F.when(F.col("_nan"), F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))  # pandas hands NaN on as null
    final = Window.partitionBy("asked_id").orderBy(F.desc("score"), key)
    top = stage_table(pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k), "best")
    few = numbered.select("asked_id").join(top.where(F.col("rank") == k).select("asked_id"), "asked_id", "left_anti")
    if few.isEmpty():
        return top
    # These scored fewer than k rows, all of them; the rest of their rows has no score and comes by key.
    rest = few.crossJoin(F.broadcast(rows.select(key).orderBy(key).limit(2 * k))).join(top.select("asked_id", key), ["asked_id", key], "left_anti")
    filled = top.drop("rank").unionByName(rest.withColumn("score", F.lit(None).cast("double")))
    return filled.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("asked_id", key, "score", "rank")


def best_rows(v: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the best ``k`` rows for each asked vector; equal vectors score alike wherever they lie, and what is no number is greatest, as in SQL."""
    out, size = [], np.sqrt((v**2).sum(axis=1)).max()
    for at in range(0, len(asked), 256):
        rough = asked[at : at + 256] @ v.T
        rough[np.isnan(rough)] = np.inf
        cuts = np.partition(rough, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(rough), -np.inf)
        for q, own, cut in zip(asked[at : at + 256], rough, cuts, strict=True):
            slack = 1e-12 * size * np.sqrt((q**2).sum())  # beyond the rounding of a product
            some = np.flatnonzero(own >= cut - slack) if np.isfinite(slack) else np.arange(len(v))  # NaN or infinite components: all rows
            score, near = np.zeros(len(some)), v[some]
            for j in range(v.shape[1]):
                score += near[:, j] * q[j]
            first = np.lexsort((ids[some], -np.where(np.isnan(score), np.inf, score)))[:k]
            out.append((ids[some][first], score[first]))
    return out


def centroids(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """``cluster, vector``: the normalised mean of unit vectors, dimension by dimension (sums combine before the shuffle)."""
    each = members.select(cluster, F.posexplode("vector").alias("d", "x")).groupBy(cluster, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = each.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vector"))
    return normalized(mean)


def cluster_examples(members: DataFrame, n: int = V.EXAMPLES, cluster: str = "cluster_id", key: str = "interaction_id") -> DataFrame:
    """The ``n`` members nearest to each centroid by unrounded similarity, which is then rounded."""
    c = centroids(members, cluster).withColumnRenamed("vector", "_c")
    scored = members.join(c, cluster).withColumn("_s", dot(F.col("vector"), F.col("_c")))
    w = Window.partitionBy(cluster).orderBy(F.desc("_s"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(cluster, key, F.bround("_s", V.DECIMALS).alias("similarity"), "rank")


def candidates(centers: DataFrame, anchors: DataFrame, n: int = V.CANDIDATES, cluster: str = "cluster_id") -> DataFrame:
    """The ``n`` intents whose best anchor is nearest to each centroid, ranked by rounded similarity.

    Clusters and anchors are a bounded number (clusters asked for, two anchors per intent of a taxonomy).
    """
    a = anchors.select("intent_id", F.col("vector").alias("_a"))
    pairs = centers.crossJoin(F.broadcast(a)).groupBy(cluster, "intent_id").agg(F.bround(F.max(dot(F.col("vector"), F.col("_a"))), V.DECIMALS).alias("similarity"))
    w = Window.partitionBy(cluster).orderBy(F.desc("similarity"), "intent_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def kmeans(members: DataFrame, k: int = V.CLUSTERS, seed: int = V.SEED, restarts: int = 10, key: str = "interaction_id") -> DataFrame:
    """``key, cluster_id`` of the best of some seeded runs; an empty cluster is an error.

    Every run starts from centres spread over a bounded sample (``kmeans.SAMPLE`` rows); then all runs are fitted in the same scans of all rows.
    """
    n = members.count()
    if not 1 <= k <= n:
        raise ValueError(f"k must be between 1 and {n}")
    data = stage_table(members.select(key, F.transform("vector", lambda x: x.cast("double")).alias("vector")), "kmeans")
    fitted = clusters.fit(data, k, seed, restarts if k > 1 else 1, key)
    out = stage_table(clusters.assigned(data, fitted.centres[int(fitted.cost.argmin())], key), "clustered")
    if out.select("cluster_id").distinct().count() < k:
        raise ValueError("a cluster is empty")
    return out


def embed(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "message", key: str = "interaction_id") -> DataFrame:
    """``key, vector`` by a model that each worker makes once and only if it has rows; vectors are normalised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        model = make()
        for b in chain([first], batches):
            if len(b):
                got = model(b["text"].tolist())
                if len(got) != len(b):
                    raise ValueError(f"the embedder returned {len(got)} vectors for {len(b)} texts")
                yield pd.DataFrame({key: b[key], "vector": got})

    made = rows.select(key, F.coalesce(text, F.lit("")).alias("text")).mapInPandas(run, f"{key} long, vector array<double>")
    return normalized(made)


def hashing_embedder(dim: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """An offline embedder: hashed character trigrams."""

    def make() -> Callable[[list[str]], list[list[float]]]:
        from zlib import crc32

        def one(text: str) -> list[float]:
            v = [0.0] * dim
            t = f"  {text.lower()}  "
            for i in range(len(t) - 2):
                h = crc32(t[i : i + 3].encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            return v

        return lambda texts: [one(t) for t in texts]

    return make


def build_index(dataset: DataFrame, make: Callable, dim: int) -> tuple[DataFrame, dict]:
    """Vectors of the eligible rows' opening texts, and the counts of indexed and skipped rows."""
    contracts.unique(dataset, "interaction_id", "interaction_id")
    total, eligible = dataset.agg(F.count("*"), F.count_if("retrieval_eligible")).first()
    docs = dataset.where("retrieval_eligible").select("interaction_id", F.element_at("turns", 1)["text"].alias("message"))
    vectors = check_vectors(stage_table(embed(docs, make), "index"), dim)
    return vectors, {"indexed": eligible, "skipped": total - eligible}
