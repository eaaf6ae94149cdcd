"""K-means with all restarts in one pass: each round scans the rows once and assigns them to the centres of every restart by a matrix product."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows at most from which runs take their first centres, and rounds over all rows.
SAMPLE, ROUNDS = 8192, 50
_SUMS = "run int, cluster int, n double, cost double, sums array<double>"


@dataclass
class Fitted:
    #: Centres of each restart (restarts x clusters x components) and the sum of squared distances to them before they last moved.
    centres: np.ndarray
    cost: np.ndarray
    rounds: int


def packed(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), dim)


def nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row for each restart (rows x restarts)."""
    runs, k, dim = centres.shape
    apart = (centres**2).sum(axis=2)[None] - 2 * (v @ centres.reshape(runs * k, dim).T).reshape(len(v), runs, k)
    cluster = apart.argmin(axis=2)
    return cluster, np.maximum(np.take_along_axis(apart, cluster[:, :, None], 2)[:, :, 0] + (v**2).sum(axis=1)[:, None], 0)


def _round(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, costs and sums of the clusters of all restarts; they are added up in each task before anything is shuffled."""
    runs, k, dim = centres.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, cost, sums = np.zeros((runs, k)), np.zeros((runs, k)), np.zeros((runs, k, dim))
        for b in batches:
            v = packed(b["vector"], dim)
            for at in range(0, len(v), 4096):
                own = v[at : at + 4096]
                cluster, apart = nearest(own, centres)
                for r in range(runs):
                    n[r] += np.bincount(cluster[:, r], minlength=k)
                    cost[r] += np.bincount(cluster[:, r], apart[:, r], k)
                    one = np.zeros((len(own), k))
                    one[np.arange(len(own)), cluster[:, r]] = 1
                    sums[r] += one.T @ own
        at = np.argwhere(n > 0)
        if not len(at):  # a task without rows: Arrow cannot tell an empty column of lists
            return
        yield pd.DataFrame({"run": at[:, 0].astype(np.int32), "cluster": at[:, 1].astype(np.int32), "n": n[n > 0], "cost": cost[n > 0], "sums": list(sums[n > 0])})

    parts = rows.select("vector").mapInPandas(run, _SUMS).select("run", "cluster", "n", "cost", F.posexplode("sums").alias("d", "x"))
    added = parts.groupBy("run", "cluster", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).collect()  # restarts x clusters x components
    n, cost, sums = np.zeros((runs, k)), np.zeros((runs, k)), np.zeros((runs, k, dim))
    for r, c, d, x, size, spent in added:
        n[r, c], cost[r, c], sums[r, c, d] = size, spent, x
    return n, cost, sums


def lloyd(rows: DataFrame, centres: np.ndarray, rounds: int, tolerance: float = 1e-4) -> Fitted:
    """Move the centres of all restarts to the means of their clusters, until none moves by more than the tolerance or the rounds are over.

    A centre without rows stays where it is. Restarts that have settled are left out of later scans.
    """
    centres, open_, cost = centres.copy(), np.arange(len(centres)), np.zeros(len(centres))
    done = 0
    while done < rounds and len(open_):
        n, spent, sums = _round(rows, centres[open_])
        moved = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], centres[open_])
        far = np.sqrt(((moved - centres[open_]) ** 2).sum(axis=2)).max(axis=1)
        centres[open_], cost[open_] = moved, spent.sum(axis=1)
        open_ = open_[far > tolerance]
        done += 1
    return Fitted(centres, cost, done)


def spread(sample: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """First centres of one run: rows of the sample, each drawn by its squared distance to those before, then moved over the sample alone."""
    chosen = [int(rng.integers(len(sample)))]
    apart = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = apart.sum()
        at = int(rng.choice(len(sample), p=apart / total)) if total > 0 else int(rng.integers(len(sample)))
        chosen.append(at)
        apart = np.minimum(apart, ((sample - sample[at]) ** 2).sum(axis=1))
    centres = sample[chosen]
    for _ in range(rounds):
        cluster = nearest(sample, centres[None])[0][:, 0]
        one = np.zeros((len(sample), k))
        one[np.arange(len(sample)), cluster] = 1
        n = one.sum(axis=0)
        centres = np.where(n[:, None] > 0, one.T @ sample / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(rows: DataFrame, k: int, seed: int, restarts: int, key: str) -> Fitted:
    """All runs over rows ``key, vector``; the same rows and seed give the same centres."""
    taken = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("vector").collect()
    sample = np.array([r[0] for r in taken], np.float64)
    centres = np.stack([spread(sample, k, np.random.default_rng(seed + r)) for r in range(restarts)])
    fitted = lloyd(rows, centres, ROUNDS)
    cost = _round(rows, fitted.centres)[1].sum(axis=1)
    return Fitted(fitted.centres, cost, fitted.rounds)


def assigned(rows: DataFrame, centres: np.ndarray, key: str) -> DataFrame:
    """``key, cluster_id`` by the nearest centre, ties by its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cluster = nearest(packed(b["vector"], centres.shape[1]), centres[None])[0][:, 0]
            yield pd.DataFrame({key: b[key], "cluster_id": cluster.astype(np.int32)})

    return rows.select(key, "vector").mapInPandas(run, f"{key} long, cluster_id int")
