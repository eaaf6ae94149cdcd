"""Intent labels of a development slice: pool checks, human corrections, distributions, review lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.contracts import gate
from ..functions.text import squeeze


def outside_pool(rows: DataFrame, pool: DataFrame, key: str = "interaction_id") -> DataFrame:
    return rows.join(pool, key, "left_anti").select(key)


def mismatched(rows: DataFrame, pool: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Rows whose record differs from the pool's (null-safe, field by field)."""
    cols = [c for c in rows.columns if c != key]
    other = pool.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in cols])
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(other, key).where(~same).select(key)


def require_pool(rows: DataFrame, pool: DataFrame, key: str = "interaction_id") -> None:
    gate(outside_pool(rows, pool, key), "rows outside the pool", key)
    gate(mismatched(rows, pool, key), "rows that differ from the pool", key)


def overlay(labels: DataFrame, corrections: DataFrame, intents: list[str] | None = None, key: str = "interaction_id") -> DataFrame:
    """Corrections replace intent and justification; the source is then human and there is no model."""
    gate(corrections.join(labels, key, "left_anti"), "corrections outside the slice", key)
    if intents is not None:
        gate(corrections.where(~F.col("intent").isin(*intents)), "corrections with unknown intents", key)
    return overlaid(labels, corrections, key)


def overlaid(labels: DataFrame, corrections: DataFrame, key: str = "interaction_id") -> DataFrame:
    c = corrections.select(key, F.col("intent").alias("_i"), squeeze(F.col("justification")).alias("_j"))
    by_hand = F.col("_i").isNotNull()
    joined = labels.join(c, key, "left").withColumns(
        {
            "intent": F.coalesce("_i", "intent"),
            "justification": F.coalesce("_j", "justification"),
            "source": F.when(by_hand, "human").otherwise(F.col("source")),
            "model": F.when(~by_hand, F.col("model")),
        }
    )
    return joined.drop("_i", "_j")


def distribution(labels: DataFrame, intents: DataFrame) -> DataFrame:
    """``ord, intent, total, labeler, human`` for every intent, zeros kept."""
    each = labels.groupBy("intent").agg(F.count("*").alias("total"), F.count_if(F.col("source") == "labeler").alias("labeler"), F.count_if(F.col("source") == "human").alias("human"))
    return intents.join(each, "intent", "left").fillna(0).select("ord", "intent", "total", "labeler", "human")


def review_rows(labels: DataFrame, n: int = V.REVIEW_EXAMPLES, key: str = "interaction_id") -> DataFrame:
    """Per intent the first ``n`` labels, human ones first, then by id, with the intent's total."""
    w = Window.partitionBy("intent")
    ranked = labels.withColumn("rank", F.row_number().over(w.orderBy(F.when(F.col("source") == "human", 0).otherwise(1), key)))
    totals = labels.groupBy("intent").agg(F.count("*").alias("total"))
    return ranked.where(F.col("rank") <= n).join(totals, "intent")


def review_report(labels: DataFrame, intents: DataFrame, n: int = V.REVIEW_EXAMPLES) -> str:
    """The review as Markdown: a section per intent, at most ``n`` labels each."""
    rows = review_rows(labels, n).orderBy("intent", "rank").collect()
    out = []
    for r in intents.orderBy("ord").collect():
        own = [x for x in rows if x["intent"] == r["intent"]]
        out.append(f"## {r['intent']} ({own[0]['total'] if own else 0})\n")
        out += [f"- {x['interaction_id']} [{x['source']}]: {x['customer_message']} ({x['justification']})" for x in own]
        if own and own[0]["total"] > len(own):
            out.append(f"- … and {own[0]['total'] - len(own)} more")
        out.append("")
    return "\n".join(out)


def discovery_markdown(report: DataFrame, clusters: DataFrame) -> str:
    """The discovery review as Markdown: a table per mapping in order, then a section per cluster."""
    out = ["| mapping | clusters | messages |", "|---|---|---|"]
    out += [f"| {r['mapping']} | {r['clusters']} | {r['messages']} |" for r in report.orderBy("ord").collect()]
    for c in clusters.orderBy("cluster_id").collect():
        out += ["", f"## Cluster {c['cluster_id']}: {c['mapping']} ({c['size']})", "", c["justification"], ""]
        out += [f"- {x['intent_id']} {x['similarity']:.6f}" for x in c["candidates"]]
        out += [f"- {x['interaction_id']} ({x['similarity']:.6f}): {x['message']}" for x in c["examples"]]
    return "\n".join(out) + "\n"
