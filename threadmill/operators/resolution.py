"""Joining labels and conversations under exact coverage, and reports over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import contracts
from ..functions import fixed_values as V
from ..plans.staging import stage_table

VERSION = 1


def missing_labels(rows: DataFrame, labels: DataFrame, key: str = "interaction_id") -> DataFrame:
    return rows.join(labels, key, "left_anti").select(key)


def unknown_labels(rows: DataFrame, labels: DataFrame, key: str = "interaction_id") -> DataFrame:
    return labels.join(rows, key, "left_anti").select(key)


def exact_join(rows: DataFrame, labels: DataFrame, key: str = "interaction_id", rule: Column | None = None) -> DataFrame:
    """Inner join of rows and labels: no duplicates on either side, nothing missing, nothing unknown, no label for which ``rule`` names an error.

    What is counted for this is observed in the one pass that writes the joined rows; ids are looked up only where a count is not zero.
    """
    others = lambda df: F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in df.columns if c != key])
    broken = F.lit(0) if rule is None else F.count_if(rule.isNotNull())
    left = rows.groupBy(key).agg(F.count("*").alias("_rows"), F.any_value(others(rows)).alias("_row"))
    right = labels.groupBy(key).agg(F.count("*").alias("_labels"), broken.alias("_broken"), F.any_value(others(labels)).alias("_label"))
    gates = [
        ("labels that break their contract", F.coalesce("_broken", F.lit(0)), "_broken > 0"),
        ("duplicate rows", (F.coalesce("_rows", F.lit(0)) > 1).cast("int"), "_rows > 1"),
        ("duplicate labels", (F.coalesce("_labels", F.lit(0)) > 1).cast("int"), "_labels > 1"),
        ("rows without a label", F.col("_labels").isNull().cast("int"), "_labels is null"),
        ("labels of unknown rows", F.col("_rows").isNull().cast("int"), "_rows is null"),
    ]
    seen = Observation("coverage")
    joined = left.join(right, key, "full_outer").observe(seen, *[F.sum(n).alias(f"g{i}") for i, (_, n, _) in enumerate(gates)])
    joined = stage_table(joined, "covered")
    for i, (what, _, where) in enumerate(gates):
        contracts.refuse(seen.get[f"g{i}"] or 0, joined.where(where), what, key)
    return joined.select(key, "_row.*", "_label.*").drop("_")


def cache_join(work: DataFrame, log: DataFrame, key: str = "interaction_id", digest: str = "prompt_sha256") -> DataFrame:
    """Rows of ``work`` with ``hit``: the log's latest record counts only if its prompt digest is that of the row."""
    record = log.select(F.col(key), F.col(digest).alias("_logged"), F.struct(*[c for c in log.columns if c not in (key, digest)]).alias("verdict"))
    joined = work.join(record, key, "left")
    hit = F.coalesce(F.col("_logged") == F.col(digest), F.lit(False))
    return joined.withColumn("hit", hit).withColumn("verdict", F.when(F.col("hit"), F.col("verdict"))).drop("_logged")


def merge_verdicts(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Final labels: heuristic ones pass, flagged ones take ``label, reason, model`` of their verdict."""
    none = F.lit(None).cast("string")
    passed = labels.where("not needs_adjudication").select("interaction_id", "label", F.lit("heuristic").alias("source"), "reason", none.alias("flag_reason"), none.alias("model"))
    flagged = labels.where("needs_adjudication").select("interaction_id", F.col("reason").alias("flag_reason"))
    judged = flagged.join(verdicts.select("interaction_id", "label", "reason", "model"), "interaction_id")
    return passed.unionByName(judged.select("interaction_id", "label", F.lit("labeler").alias("source"), "reason", "flag_reason", "model"))


def adjudication_report(final: DataFrame) -> DataFrame:
    """Counts by label, and by source and label (``source`` null: all)."""
    sets = final.groupingSets([("label",), ("source", "label")], "source", "label")
    return sets.agg(F.count("*").alias("n"))


def models_in_order(final: DataFrame, position: str) -> DataFrame:
    """Distinct models by first appearance."""
    return final.where("model is not null").groupBy("model").agg(F.min(position).alias("first")).orderBy("first", "model")


def build_dataset(final: DataFrame, interactions: DataFrame) -> DataFrame:
    return with_eligibility(exact_join(interactions, final, rule=contracts.final_label()))


def with_eligibility(joined: DataFrame) -> DataFrame:
    return joined.withColumns({"dataset_version": F.lit(VERSION), "retrieval_eligible": F.col("label") == "resolved"})


def by_source(dataset: DataFrame) -> DataFrame:
    """Per source the count of each label (zeros kept) and the eligible volume."""
    names = dataset.sparkSession.createDataFrame([("heuristic",), ("labeler",)], "source string")
    counted = dataset.groupBy("source").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("label") == x).alias(x) for x in V.CLOSURE_LABELS], F.count_if("retrieval_eligible").alias("eligible")
    )
    zero = {c: 0 for c in ("total", *V.CLOSURE_LABELS, "eligible")}
    out = names.join(counted, "source", "left").fillna(zero)
    return out.withColumn("eligible_share", F.coalesce(F.try_divide("eligible", "total"), F.lit(0.0)))
