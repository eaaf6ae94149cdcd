"""Hybrid ranking over two indexes by a threshold algorithm.

A document's score is a weighted sum of its BM25 score and its vector's cosine, each as a share of the best one for that entry, and a boost for
the same intent. Both indexes hand out their best documents down to a depth; the documents that either names are scored by both. A document
that neither has named scores at most what the last ones of both lists would together, with the boost; an entry whose k-th score is above that is
done, for the others the depth grows. So what is read follows k, not the corpus, and the result is exact.

Documents that have no word in common and no vector are no candidates. A best score of zero or less counts for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage_table
from . import lexical, vector_index

DEPTH, GROWTH = 8, 4


def topk(
    words: lexical.LexicalIndex, vectors: vector_index.VectorIndex, asked: DataFrame, intents: DataFrame, k: int = 5, weight: float = 0.5, boost: float = 0.1, depth: int = DEPTH
) -> tuple[DataFrame, int]:
    """``asked_id, doc_id, score, rank`` for rows ``asked_id, text, vector, intent``, and the depth that was needed; ``intents``: ``doc_id, intent``."""
    asked = stage_table(asked.select(F.col("asked_id").cast("long").alias("asked_id"), "text", "vector", "intent"), "hybrid-asked")
    terms = lexical.weighted(words, asked.select("asked_id", "text"))
    deepest = max(words.documents, vectors.parts().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    m, open_, done = max(k, depth), asked, None
    while True:
        own = terms.join(open_.select("asked_id"), "asked_id", "left_semi")
        by_word = stage_table(lexical.searched(words, own, m)[0], "by-word")
        by_vector = vector_index.topk(vectors, open_.where("vector is not null").select("asked_id", "vector"), m).withColumnRenamed("interaction_id", "doc_id")
        by_vector = stage_table(by_vector, "by-vector")
        best = lambda d, c: d.groupBy("asked_id").agg(F.max("score").alias(f"{c}_best"), F.max(F.when(F.col("rank") == m, F.col("score"))).alias(f"{c}_last"))
        ends = stage_table(open_.select("asked_id", F.col("intent").alias("asked_intent")).join(best(by_word, "w"), "asked_id", "left").join(best(by_vector, "v"), "asked_id", "left"), "ends")
        pairs = stage_table(by_word.select("asked_id", "doc_id").unionByName(by_vector.select("asked_id", "doc_id")).distinct(), "named")
        w = lexical.scores_of(words, own, pairs).withColumnRenamed("score", "w")
        v = vector_index.scores_of(vectors, open_.where("vector is not null"), pairs.withColumnRenamed("doc_id", "interaction_id"))
        v = v.select("asked_id", F.col("interaction_id").alias("doc_id"), F.col("score").alias("v"))
        share = lambda c: F.when(F.col(f"{c}_best") > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col(f"{c}_best")).otherwise(0.0)
        all_ = pairs.join(w, ["asked_id", "doc_id"], "left").join(v, ["asked_id", "doc_id"], "left").join(ends, "asked_id").join(intents, "doc_id", "left")
        score = weight * share("w") + (1 - weight) * share("v") + F.when(F.col("intent") == F.col("asked_intent"), boost).otherwise(0.0)
        order = Window.partitionBy("asked_id").orderBy(F.round("score", 9).desc(), "doc_id")
        ranked = all_.select("asked_id", "doc_id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = stage_table(ranked, "hybrid")
        last = lambda c: F.when(F.col(f"{c}_best") > 0, F.greatest(F.coalesce(F.col(f"{c}_last"), F.lit(0.0)), F.lit(0.0)) / F.col(f"{c}_best")).otherwise(0.0)
        unseen = ends.select("asked_id", (weight * last("w") + (1 - weight) * last("v") + boost).alias("most"), (F.col("w_last").isNull() & F.col("v_last").isNull()).alias("whole"))
        kth = ranked.where(F.col("rank") == k).select("asked_id", F.col("score").alias("kth"))
        settled = unseen.join(kth, "asked_id", "left").where(F.col("whole") | (F.col("kth") > F.col("most") + 1e-8)).select("asked_id")
        settled = stage_table(settled, "settled")
        final = m >= deepest
        now = ranked if final else ranked.join(settled, "asked_id", "left_semi")
        done = now if done is None else done.unionByName(now)
        open_ = stage_table(open_.join(settled, "asked_id", "left_anti"), "hybrid-open")
        if final or open_.isEmpty():
            return done, m
        m = min(m * GROWTH, deepest)
