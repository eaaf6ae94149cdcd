"""How a conversation ended: ordered rules over its closing turns, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import acknowledges, continues, has, plain_apostrophes


def closing_turns(interactions: DataFrame) -> DataFrame:
    """``interaction_id, last_side, last_text, customer_text, customer_is_opening, brand_text``.

    ``customer_text`` is the last customer turn, ``brand_text`` the last brand turn before the final one.
    """
    turns = F.col("turns")
    numbered = F.transform(turns, lambda t, i: F.struct(i.alias("i"), t["side"].alias("side"), t["text"].alias("text")))
    last = lambda side, of: F.try_element_at(F.filter(of, lambda t: t["side"] == side), F.lit(-1))
    earlier = F.slice(numbered, 1, F.size(turns) - 1)
    return interactions.where(F.size("turns") > 0).select(
        "interaction_id",
        F.element_at(turns, -1)["side"].alias("last_side"),
        F.element_at(turns, -1)["text"].alias("last_text"),
        last("customer", numbered)["text"].alias("customer_text"),
        F.coalesce(last("customer", numbered)["i"] == 0, F.lit(False)).alias("customer_is_opening"),
        last("brand", earlier)["text"].alias("brand_text"),
    )


def label_closings(closings: DataFrame) -> DataFrame:
    """``interaction_id, label, reason, needs_adjudication`` by the rules' order; a flagged ending has no label."""
    text, customer, brand = (plain_apostrophes(F.col(c)) for c in ("last_text", "customer_text", "brand_text"))

    def out(label: str | None, reason: str) -> Column:
        return F.struct(F.lit(label).cast("string").alias("label"), F.lit(V.REASONS[reason]).alias("reason"))

    by_customer = (
        F.when(has(text, "dm_reply"), out(None, "customer_dm"))
        .when(continues(text), out("unresolved", "customer_continues"))
        .when(~acknowledges(text), out(None, "customer_unclear"))
        .when(F.coalesce(has(brand, "deflection"), F.lit(False)) & ~has(text, "fixed"), out(None, "customer_dm_ack"))
        .otherwise(out("resolved", "customer_resolved"))
    )
    acked = F.coalesce(~F.col("customer_is_opening") & ~continues(customer) & acknowledges(customer), F.lit(False))
    followup, question = has(text, "followup"), has(text, "question")
    by_brand = (
        F.when(has(text, "completion"), out("resolved", "brand_completion"))
        .when(has(text, "deflection"), out(None, "brand_dm"))
        .when(has(text, "refusal"), out("unresolved", "brand_refusal"))
        .when(acked & ~followup & (~question | has(text, "soft_invite")), out("resolved", "brand_ack_close"))
        .when(followup, out("uncertain", "brand_followup"))
        .when(question, out("uncertain", "brand_question"))
        .otherwise(out("uncertain", "brand_silence"))
    )
    judged = closings.select("interaction_id", F.when(F.col("last_side") == "customer", by_customer).otherwise(by_brand).alias("r"))
    return judged.select("interaction_id", "r.label", "r.reason", F.col("r.label").isNull().alias("needs_adjudication"))


def label_interactions(interactions: DataFrame) -> DataFrame:
    return label_closings(closing_turns(interactions))


def closure_report(labels: DataFrame) -> DataFrame:
    """One row: counts of the labels and of flags, and their shares."""
    n = lambda c: F.count_if(c)
    counts = labels.agg(F.count("*").alias("total"), *[n(F.col("label") == x).alias(x) for x in V.CLOSURE_LABELS], n("needs_adjudication").alias("flagged"))
    share = lambda c: F.coalesce(F.try_divide(c, F.col("total")), F.lit(0.0))
    return counts.withColumns({"label_rate": share(F.col("total") - F.col("flagged")), "adjudication_rate": share(F.col("flagged"))})


def flagged_by_reason(labels: DataFrame) -> DataFrame:
    return labels.where("needs_adjudication").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")
