"""Routing clusters to final intents by a taxonomy's decisions, and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import gate


def decision_gaps(clusters: DataFrame, seeds: DataFrame, seed_decisions: DataFrame, theme_decisions: DataFrame) -> DataFrame:
    """``subject, problem``: seeds (but ``other``) and new clusters without a decision, and decisions without either."""
    own = seeds.where("intent_id <> 'other'").select(F.col("intent_id").alias("subject"))
    new = clusters.where("mapping = 'new'").select(F.col("cluster_id").cast("string").alias("subject"))
    parts = [
        own.join(seed_decisions, "subject", "left_anti").select("subject", F.lit("seed without a decision").alias("problem")),
        seed_decisions.join(own, "subject", "left_anti").select("subject", F.lit("decision on an unknown seed").alias("problem")),
        new.join(theme_decisions, "subject", "left_anti").select("subject", F.lit("theme without a decision").alias("problem")),
        theme_decisions.join(new, "subject", "left_anti").select("subject", F.lit("decision on an unknown theme").alias("problem")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def route(clusters: DataFrame, seed_decisions: DataFrame, theme_decisions: DataFrame) -> DataFrame:
    """``cluster_id, size, mapping, final_intent``: junk is other; new themes and seeds follow their decision.

    A dropped theme is other; a cluster of a dropped or unknown seed has no intent (null).
    """
    s = seed_decisions.select(F.col("subject").alias("mapping"), F.col("final_intent").alias("_seed"))
    t = theme_decisions.select(F.col("subject").cast("long").alias("cluster_id"), F.coalesce("final_intent", F.lit("other")).alias("_theme"))
    joined = clusters.join(s, "mapping", "left").join(t, "cluster_id", "left")
    final = F.when(F.col("mapping").isin("junk", "other"), "other").when(F.col("mapping") == "new", F.col("_theme")).otherwise(F.col("_seed"))
    return joined.select("cluster_id", "size", "mapping", final.alias("final_intent"))


def coverage(routed: DataFrame, intents: DataFrame) -> DataFrame:
    """``ord, intent_id, clusters, messages`` for every intent, zeros kept."""
    each = routed.groupBy(F.col("final_intent").alias("intent_id")).agg(F.count("*").alias("clusters"), F.sum("size").alias("messages"))
    return intents.select("ord", "intent_id").join(each, "intent_id", "left").fillna(0).select("ord", "intent_id", "clusters", "messages")


def covered_share(covered: DataFrame) -> DataFrame:
    """One row: messages, those of support intents, and their share."""
    support = F.sum(F.when(F.col("intent_id") != "other", F.col("messages")).otherwise(0))
    return covered.agg(F.sum("messages").alias("messages"), support.alias("covered")).withColumn("covered_share", F.coalesce(F.try_divide("covered", "messages"), F.lit(0.0)))


def reconcile(clusters: DataFrame, seeds: DataFrame, taxonomy: dict) -> DataFrame:
    """Coverage after all gates: decisions are complete, every cluster has an intent, every support intent has a cluster."""
    gate(decision_gaps(clusters, seeds, taxonomy["seed_decisions"], taxonomy["theme_decisions"]), "decisions do not fit", "subject")
    routed = route(clusters, taxonomy["seed_decisions"], taxonomy["theme_decisions"])
    gate(routed.where("final_intent is null"), "clusters without an intent", "cluster_id")
    covered = coverage(routed, taxonomy["intents"])
    gate(covered.where("clusters = 0 and intent_id <> 'other'"), "intents without a cluster", "intent_id")
    return covered.orderBy("ord")


def discovery_report(clusters: DataFrame, seeds: DataFrame) -> DataFrame:
    """``ord, mapping, clusters, messages`` per seed in order, then new and junk; zeros kept."""
    spark = clusters.sparkSession
    names = seeds.where("intent_id <> 'other'").select("ord", F.col("intent_id").alias("mapping"))
    names = names.unionByName(spark.createDataFrame([(1 << 20, "new"), ((1 << 20) + 1, "junk")], "ord int, mapping string"))
    each = clusters.groupBy("mapping").agg(F.count("*").alias("clusters"), F.sum("size").alias("messages"))
    return names.join(each, "mapping", "left").fillna(0).select("ord", "mapping", "clusters", "messages").orderBy("ord")
