"""Discovering intents: clusters of messages, their examples and candidates, and a verdict on each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contracts
from ..plans.staging import stage_table
from . import vectors
from .inference import cached, cluster_prompt, definitions_text, reply_fields, valid_reply

SYSTEM = "You map clusters of support messages to intents. Reply with a JSON object with mapping and justification."


def support_intents(seeds: DataFrame) -> DataFrame:
    """Seeds without ``other``; there must be some."""
    own = seeds.where("intent_id <> 'other'")
    if own.isEmpty():
        raise ValueError("no support intents")
    return own


def discover(messages: DataFrame, anchors: DataFrame, seeds: DataFrame, make_embedder: Callable, make_labeler: Callable, log_path: str, k: int = 30, seed: int = 42, restarts: int = 10, rules: str = "") -> DataFrame:
    """Cluster records from messages ``interaction_id, message``, anchors ``intent_id, message`` (two per seed) and seeds ``ord, intent_id, definition``.

    ``rules`` are further ones for the boundaries between the intents. Replies may be fenced or wrapped in prose.
    """
    members = stage_table(vectors.embed(messages, make_embedder), "members")
    placed = stage_table(members.join(vectors.kmeans(members, k, seed, restarts), "interaction_id"), "placed")
    numbered = anchors.withColumn("interaction_id", F.xxhash64("intent_id", "message"))
    known = numbered.join(vectors.embed(numbered, make_embedder), "interaction_id").select("intent_id", "vector")
    best = vectors.candidates(vectors.centroids(placed), known.join(support_intents(seeds), "intent_id", "left_semi"))
    best = best.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "intent_id", "similarity"))), lambda c: F.struct(c["intent_id"].alias("intent_id"), c["similarity"].alias("similarity"))).alias("candidates"))
    shown = vectors.cluster_examples(placed).join(messages, "interaction_id")
    shown = shown.groupBy("cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "interaction_id", "message", "similarity"))), lambda c: F.struct(c["interaction_id"].alias("interaction_id"), c["message"].alias("message"), c["similarity"].alias("similarity"))).alias("examples")
    )
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("size"))
    clusters = stage_table(sizes.join(best, "cluster_id").join(shown, "cluster_id").withColumn("cluster_id", F.col("cluster_id").cast("long")), "clusters")
    own = support_intents(seeds)
    names = [r[0] for r in own.select("intent_id").collect()] + ["new", "junk"]
    work = clusters.select("cluster_id", cluster_prompt(F.col("size"), F.col("examples"), F.col("candidates"), definitions_text(own), rules).alias("prompt"))
    said = cached(work, log_path, make_labeler, SYSTEM, valid_reply("mapping", names), key="cluster_id")
    said = said.select("cluster_id", reply_fields(F.col("reply"), "mapping", names).alias("r")).select("cluster_id", F.col("r.value").alias("mapping"), F.col("r.text").alias("justification"))
    out = clusters.join(said, "cluster_id").select("cluster_id", "size", "mapping", "justification", "candidates", "examples")
    contracts.gate(out.where(contracts.cluster(names).isNotNull()), "clusters that break their contract", "cluster_id")
    return out
