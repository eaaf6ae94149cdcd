"""Reproducible samples: rows in the order of a seeded digest of their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import hash_rank, is_blank


def hash_sample(rows: DataFrame, n: int, seed: int = V.SEED, key: str = "interaction_id") -> DataFrame:
    """The first ``n`` rows by digest, then key: independent of order, and a larger sample contains a smaller one."""
    return rows.orderBy(hash_rank(seed, F.col(key)), key).limit(n)


def sample_split(rows: DataFrame, sample: int = V.SAMPLE_SIZE, holdout: int = V.HOLDOUT_SIZE, seed: int = V.SEED, key: str = "interaction_id") -> DataFrame:
    """Sampled rows with ``split`` (holdout or pool). With fewer rows than asked for, the holdout shrinks in proportion.

    The sample is bounded by its size, so ranking it in one place is too.
    """
    if sample < 1 or not 0 <= holdout < sample:
        raise ValueError("sample must be positive and holdout smaller")
    picked = hash_sample(rows, sample, seed, key).withColumn("_rank", F.row_number().over(Window.orderBy(hash_rank(seed, F.col(key)), key)))
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    held = F.when(n < sample, F.expr(f"({holdout} * 1L)") * n / sample).otherwise(F.lit(holdout).cast("double"))
    return picked.withColumn("split", F.when(F.col("_rank") <= F.floor(held), "holdout").otherwise("pool")).drop("_rank")


def dev_slice(rows: DataFrame, n: int = V.DEV_SLICE, seed: int = V.SEED, key: str = "interaction_id", message: str = "message") -> DataFrame:
    """A sample of the rows with a non-blank message."""
    return hash_sample(rows.where(~is_blank(F.col(message))), n, seed, key)
