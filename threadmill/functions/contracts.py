"""Record contracts as columns: the first violated rule as text, or null. Writers and readers use the same ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import is_blank


def rules(*pairs: tuple[Column, str]) -> Column:
    """The message of the first condition that does not hold (null counts as not holding)."""
    out = None
    for ok, message in pairs:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, F.lit(message)) if out is None else out.when(bad, F.lit(message))
    return out


def interaction() -> Column:
    turn = lambda t: (
        t["tweet_id"].isNotNull() & t["author_id"].isNotNull() & F.coalesce(t["side"].isin("customer", "brand"), F.lit(False)) & t["created_at"].isNotNull() & t["text"].isNotNull()
    )
    return rules(
        (F.col("interaction_id").isNotNull(), "interaction_id must be an integer"),
        (F.col("customer_id").isNotNull() & F.col("brand_id").isNotNull(), "customer_id and brand_id must be strings"),
        (F.size("turns") > 0, "turns must not be empty"),
        (F.forall("turns", turn), "a turn is malformed"),
        (F.element_at("turns", 1)["side"] == "customer", "the first turn must be the customer's"),
    )


def closure_label() -> Column:
    label = F.col("label")
    return rules(
        (F.col("interaction_id").isNotNull(), "interaction_id must be an integer"),
        (label.isNull() | label.isin(*V.CLOSURE_LABELS), "unknown label"),
        (~is_blank(F.col("reason")), "reason must not be blank"),
        (F.col("needs_adjudication") == label.isNull(), "needs_adjudication must say whether the label is missing"),
    )


def final_label() -> Column:
    flag, model = F.col("flag_reason"), F.col("model")
    return rules(
        (F.col("interaction_id").isNotNull(), "interaction_id must be an integer"),
        (F.col("label").isin(*V.CLOSURE_LABELS), "unknown label"),
        (F.col("source").isin("heuristic", "labeler"), "unknown source"),
        (~is_blank(F.col("reason")), "reason must not be blank"),
        ((F.col("source") == "labeler") | (flag.isNull() & model.isNull()), "heuristic labels carry no flag_reason or model"),
        ((F.col("source") == "heuristic") | (~is_blank(flag) & ~is_blank(model)), "labeler labels need flag_reason and model"),
    )


def resolution() -> Column:
    own = rules(
        (F.col("dataset_version") == 1, "dataset_version must be 1"),
        (F.col("retrieval_eligible") == (F.col("label") == "resolved"), "retrieval_eligible must say whether the label is resolved"),
    )
    return F.coalesce(final_label(), interaction(), own)


def cluster(intents: Sequence[str] | None = None) -> Column:
    known = F.lit(True) if intents is None else F.col("mapping").isin(*intents, "new", "junk")
    number = lambda c: c.isNotNull() & ~F.isnan(c)
    return rules(
        (F.col("cluster_id") >= 0, "cluster_id must not be negative"),
        (F.col("size") >= 1, "size must be positive"),
        (known, "unknown mapping"),
        (~is_blank(F.col("justification")), "justification must not be blank"),
        (F.size("candidates") > 0, "candidates must not be empty"),
        (F.forall("candidates", lambda c: ~is_blank(c["intent_id"]) & number(c["similarity"])), "a candidate is malformed"),
        (F.size("examples") > 0, "examples must not be empty"),
        (F.forall("examples", lambda c: c["interaction_id"].isNotNull() & c["message"].isNotNull() & number(c["similarity"])), "an example is malformed"),
    )


def queue_item() -> Column:
    return rules(
        (F.col("interaction_id").isNotNull(), "interaction_id must be an integer"),
        (~is_blank(F.col("hint_intent")), "hint_intent must not be blank"),
        (F.col("hint_decision").isin("auto", "escalate"), "unknown hint_decision"),
    )


def golden(intents: Sequence[str] | None = None) -> Column:
    known = F.lit(True) if intents is None else F.col("gold_intent").isin(*intents)
    own = rules(
        (F.col("taxonomy_version") >= 1, "taxonomy_version must be positive"),
        (~is_blank(F.col("customer_message")), "customer_message must not be blank"),
        (~is_blank(F.col("gold_intent")) & known, "unknown gold_intent"),
        (F.col("gold_decision").isin("auto", "escalate"), "unknown gold_decision"),
        (F.col("notes").isNotNull(), "notes must be a string"),
    )
    return F.coalesce(queue_item(), own)


def intent_label() -> Column:
    return rules(
        (F.col("interaction_id").isNotNull(), "interaction_id must be an integer"),
        (~is_blank(F.col("customer_message")), "customer_message must not be blank"),
        (~is_blank(F.col("intent")), "intent must not be blank"),
        (F.col("source").isin("labeler", "human"), "unknown source"),
        ((F.col("source") == "human") == F.col("model").isNull(), "labelers name their model, humans have none"),
        (F.col("taxonomy_version") >= 1, "taxonomy_version must be positive"),
    )


def correction() -> Column:
    return rules(
        (F.col("interaction_id").isNotNull(), "interaction_id must be an integer"),
        (~is_blank(F.col("intent")), "intent must not be blank"),
        (~is_blank(F.col("justification")), "justification must not be blank"),
    )


def vector(dim: int) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rules(
        (F.col("interaction_id").isNotNull(), "interaction_id must be an integer"),
        (F.size("vector") == dim, f"a vector must have {dim} numbers"),
        (F.forall("vector", finite), "a vector must hold finite numbers"),
    )


def decision(dropped_targets_only: bool = False) -> Column:
    """Seed and theme decisions: what each kind says about its target."""
    d, target = F.col("decision"), F.col("final_intent")
    return rules(
        (d.isin("kept", "merged", "dropped", "promoted"), "unknown decision"),
        ((d != "kept") | (target == F.col("subject")), "a kept intent keeps its id"),
        ((d != "merged") | (target.isNotNull() & (target != F.col("subject"))), "a merged intent has another target"),
        ((d != "dropped") | target.isNull(), "a dropped intent has no target"),
        ((d != "promoted") | target.isNotNull(), "a promoted theme needs a target"),
    )


class ContractError(ValueError):
    """Records break their contract."""


def gate(bad: DataFrame, what: str, key: str) -> None:
    """Raise with the number of rows and the five smallest keys, if there are any rows."""
    refuse(bad.groupBy().agg(F.count("*").alias("n")).first()["n"], bad, what, key)


def refuse(first: int, bad: DataFrame, what: str, key: str) -> None:
    """Raise if a count of bad rows, observed where they passed, is not zero; only then they are read."""
    if first:
        keys = [r[0] for r in bad.select(key).orderBy(key).limit(5).collect()]
        raise ContractError(f"{first} {what}: {', '.join(map(str, keys))}{', …' if first > 5 else ''}")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """``key, n`` of keys that more than one row has."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, key: str, what: str) -> None:
    gate(duplicates(df, key), f"duplicate {what}", key)


def covers(labels: DataFrame, rows: DataFrame, key: str = "interaction_id") -> None:
    """Every row has exactly one label and no label is of another row."""
    unique(labels, key, "labels")
    gate(rows.join(labels, key, "left_anti").select(key), "rows without a label", key)
    gate(labels.join(rows, key, "left_anti").select(key), "labels of unknown rows", key)
