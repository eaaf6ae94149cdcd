"""Second-tier operators: baselines, lexical and hybrid retrieval, the auto/escalate policy, evaluation metrics."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage_table


def hybrid(lexical: DataFrame, dense: DataFrame, weight: float = 0.5, boost: float = 0.1, k: int = 5) -> DataFrame:
    """``asked_id, doc_id, score`` from two score tables (scaled by the best of each asked text) and ``same_intent`` of the dense one."""
    best = lambda d: d.withColumn("score", F.coalesce(F.try_divide(F.col("score"), F.max("score").over(Window.partitionBy("asked_id"))), F.lit(0.0)))
    both = best(lexical).select("asked_id", "doc_id", F.col("score").alias("l")).join(best(dense).select("asked_id", "doc_id", F.col("score").alias("d"), "same_intent"), ["asked_id", "doc_id"], "full")
    score = weight * F.coalesce("l", F.lit(0.0)) + (1 - weight) * F.coalesce("d", F.lit(0.0)) + F.when(F.col("same_intent"), boost).otherwise(0.0)
    w = Window.partitionBy("asked_id").orderBy(F.desc("score"), "doc_id")
    return both.select("asked_id", "doc_id", score.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def grounded_prompt(message: Column, evidence: Column) -> Column:
    """A prompt for a reply that keeps to its evidence (an array of texts)."""
    cases = F.array_join(F.transform(evidence, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e)), "\n")
    return F.concat(F.lit("Past cases:\n"), cases, F.lit("\n\nMessage: "), message, F.lit("\n\nReply using only what the cases support."))


def decide(intent: Column, confidence: Column, evidence: Column, high_risk: list[str], account_specific: list[str], least_confidence: float = 0.7, least_evidence: float = 0.5) -> Column:
    """``decision, reason`` by ordered rules: high risk, account-specific, low confidence and weak evidence escalate."""
    out = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return (
        F.when(intent.isin(*high_risk), out("escalate", "high-risk intent"))
        .when(intent.isin(*account_specific), out("escalate", "account-specific intent"))
        .when(F.coalesce(confidence, F.lit(0.0)) < least_confidence, out("escalate", "low confidence"))
        .when(F.coalesce(evidence, F.lit(0.0)) < least_evidence, out("escalate", "weak evidence"))
        .otherwise(out("auto", "confident and grounded"))
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """``gold, predicted, n``."""
    return pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def per_class(pairs: DataFrame) -> DataFrame:
    """``label, support, precision, recall, f1`` for every label that occurs on either side."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit("gold").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("predicted").alias("side")))).alias("x"), (F.col("gold") == F.col("predicted")).alias("hit"))
    c = both.groupBy("x.label").agg(F.count_if(F.col("x.side") == "gold").alias("support"), F.count_if(F.col("x.side") == "predicted").alias("guessed"), F.count_if(F.col("hit") & (F.col("x.side") == "gold")).alias("hits"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select("label", "support", rate(F.col("hits"), F.col("guessed")).alias("precision"), rate(F.col("hits"), F.col("support")).alias("recall"), rate(2 * F.col("hits"), F.col("guessed") + F.col("support")).alias("f1"))


def summary(pairs: DataFrame) -> DataFrame:
    """One row: accuracy and macro-F1 over the gold labels."""
    macro = per_class(pairs).where("support > 0").agg(F.avg("f1").alias("macro_f1"))
    return pairs.agg(F.count("*").alias("n"), F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy")).join(F.broadcast(macro))  # one row


def auto_rates(pairs: DataFrame) -> DataFrame:
    """One row from ``gold, predicted`` decisions: share handled automatically, and share of those that should not be."""
    auto, false = F.count_if(F.col("predicted") == "auto"), F.count_if((F.col("predicted") == "auto") & (F.col("gold") == "escalate"))
    out = pairs.agg(F.count("*").alias("n"), auto.alias("auto"), false.alias("false_auto"))
    return out.withColumns({"auto_rate": F.coalesce(F.try_divide("auto", "n"), F.lit(0.0)), "false_auto_rate": F.coalesce(F.try_divide("false_auto", "auto"), F.lit(0.0))})


def agreement(pairs: DataFrame, a: str = "judge", b: str = "human") -> DataFrame:
    """One row: observed agreement of two raters and Cohen's kappa."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("c"))
    out = total.join(F.broadcast(chance))  # one row each
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t").cast("double") * F.col("t"))
    return out.select(F.col("t").alias("n"), po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def majority(train: DataFrame, label: str = "intent") -> DataFrame:
    """The most frequent label (ties by name)."""
    return train.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1)


def tfidf_baseline(train: DataFrame, text: str = "message", label: str = "intent", features: int = 1 << 14) -> PipelineModel:
    """A TF-IDF and logistic-regression model; texts are cut into words once, for both fits."""
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep").fit(train)
    words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}]+")
    counts = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features)
    counted = stage_table(counts.transform(words.transform(index.transform(train))).select("_y", "_tf"), "term-counts")
    idf = IDF(inputCol="_tf", outputCol="_x").fit(counted)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=30).fit(idf.transform(counted))
    return PipelineModel(stages=[index, words, counts, idf, model])


def case_format(dataset: DataFrame, intents: DataFrame) -> DataFrame:
    """``conversation_id, customer_message, brand_reply, intent, resolution``."""
    brand = F.try_element_at(F.filter("turns", lambda t: t["side"] == "brand"), F.lit(1))["text"]
    return dataset.join(intents.select("interaction_id", "intent"), "interaction_id", "left").select(
        F.col("interaction_id").alias("conversation_id"), F.element_at("turns", 1)["text"].alias("customer_message"), brand.alias("brand_reply"), "intent", F.col("label").alias("resolution")
    )
