"""Typed, strict scans: message CSV, JSON lines under a contract, append-only logs, vector indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contracts
from ..functions.contracts import ContractError, gate, unique
from .archive import SourceError

TWEET_COLUMNS = ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")
TURNS = "array<struct<tweet_id: bigint, author_id: string, side: string, created_at: string, text: string>>"
INTERACTION = f"interaction_id bigint, customer_id string, brand_id string, turns {TURNS}"
FINAL_LABEL = "interaction_id bigint, label string, source string, reason string, flag_reason string, model string"
SCHEMAS = {
    "interactions": INTERACTION,
    "closure_labels": "interaction_id bigint, label string, reason string, needs_adjudication boolean",
    "final_labels": FINAL_LABEL,
    "resolutions": f"{FINAL_LABEL}, dataset_version int, retrieval_eligible boolean, customer_id string, brand_id string, turns {TURNS}",
    "clusters": "cluster_id bigint, size bigint, mapping string, justification string, candidates array<struct<intent_id: string, similarity: double>>, examples array<struct<interaction_id: bigint, message: string, similarity: double>>",
    "queue": "interaction_id bigint, hint_intent string, hint_decision string",
    "golden": "interaction_id bigint, taxonomy_version int, customer_message string, gold_intent string, gold_decision string, notes string, hint_intent string, hint_decision string",
    "intent_labels": "interaction_id bigint, customer_message string, intent string, source string, justification string, model string, taxonomy_version int",
    "corrections": "interaction_id bigint, intent string, justification string",
}
CONTRACTS = {
    "interactions": contracts.interaction,
    "closure_labels": contracts.closure_label,
    "final_labels": contracts.final_label,
    "resolutions": contracts.resolution,
    "clusters": contracts.cluster,
    "queue": contracts.queue_item,
    "golden": contracts.golden,
    "intent_labels": contracts.intent_label,
    "corrections": contracts.correction,
}


def source_time(text: Column) -> Column:
    """``Wed Nov 01 10:00:00 +0000 2017`` in UTC only; anything else is null."""
    ok = text.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} \+0000 \d{4}$")
    return F.when(ok, F.try_to_timestamp(F.substring(text, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")))


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """``tweet_id, author_id, inbound, created_at, text, parent_id``; the header, each row and the ids' uniqueness are checked."""
    header = spark.read.csv(path, header=False, quote='"', escape='"').first()
    if header is None or tuple((c or "").lstrip("﻿") for c in header) != TWEET_COLUMNS:
        raise SourceError(f"{path} must have the columns {', '.join(TWEET_COLUMNS)}")
    schema = ", ".join(f"{c} string" for c in TWEET_COLUMNS) + ", broken string"
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="broken")
    parent = F.col("in_response_to_tweet_id")
    rows = raw.select(
        F.col("tweet_id").try_cast("long").alias("tweet_id"),
        "author_id",
        F.when(F.col("inbound") == "True", True).when(F.col("inbound") == "False", False).alias("inbound"),
        source_time(F.col("created_at")).alias("created_at"),
        F.coalesce("text", F.lit("")).alias("text"),
        parent.try_cast("long").alias("parent_id"),
        (F.col("broken").isNotNull() | (parent.isNotNull() & parent.try_cast("long").isNull())).alias("broken"),
    )
    needed = F.col("broken") | F.col("tweet_id").isNull() | F.col("author_id").isNull() | F.col("inbound").isNull() | F.col("created_at").isNull()
    gate(rows.where(needed), "malformed rows", "tweet_id")
    unique(rows, "tweet_id", "tweet_id")
    return rows.drop("broken")


def read_records(spark: SparkSession, path: str, kind: str, contract: Column | None = None, key: str | None = None) -> DataFrame:
    """JSON lines of one of ``SCHEMAS``: blank lines are skipped, every other line must satisfy the contract.

    Numbers must be integers where ids are: ``true`` and ``1.0`` are not. An error names the file's line.
    """
    key = key or ("cluster_id" if kind == "clusters" else "interaction_id")
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    full = lines.where(~F.col("value").rlike(r"(?U)^\s*$"))
    parsed = full.select("at", F.from_json("value", SCHEMAS[kind] + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")).select("at", "r.*")
    rule = contract if contract is not None else CONTRACTS[kind]()
    checked = parsed.withColumn("error", F.when(F.col("_broken").isNotNull(), "not a JSON object of this kind").otherwise(rule))
    bad = checked.where("error is not null").orderBy("at").limit(1).collect()
    if bad:
        line = lines.where(F.col("at") <= bad[0]["at"]).count()
        raise ContractError(f"{path}, line {line}: {bad[0]['error']}")
    rows = parsed.drop("at", "_broken")
    unique(rows, key, key)
    return rows


def read_log(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last record per key of an append-only log of JSON lines. A missing file is empty; a malformed last line that
    has no line end is dropped, any other is an error. The lines are read and checked by the executors."""
    ended = _ends_line(spark, path)
    if ended is None:
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path, lineSep="\n").withColumn("seq", F.monotonically_increasing_id())
    full = lines.where(~F.col("value").rlike(r"(?U)^\s*$"))
    bad = full.where(F.try_parse_json("value").isNull()).orderBy("seq").limit(1).collect()
    if bad:
        if ended or bad[0]["seq"] != lines.agg(F.max("seq")).first()[0]:
            raise ContractError(f"{path}, line {lines.where(F.col('seq') <= bad[0]['seq']).count()}: malformed record")
        full = full.where(F.col("seq") < bad[0]["seq"])
    return latest(full.select("seq", F.from_json("value", schema).alias("r")).select("seq", "r.*"), key, "seq").drop("seq")


def _ends_line(spark: SparkSession, path: str) -> bool | None:
    """Whether a file's last byte ends a line; None for a missing or empty file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen() if fs.exists(p) else 0
    if not size:
        return None
    opened = fs.open(p)
    try:
        opened.seek(size - 1)
        return opened.read() == 10
    finally:
        opened.close()


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The record with the greatest sequence number of each key."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("r")).select(key, "r.*")


def ordered_latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """As ``latest``, by a window."""
    w = Window.partitionBy(key).orderBy(F.col(seq).desc())
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def write_index(vectors: DataFrame, folder: str, model: str, dim: int, build_time_s: float) -> None:
    """A vector index: Parquet vectors and a row of metadata."""
    spark = vectors.sparkSession
    meta = spark.createDataFrame([(1, model, dim, float(build_time_s))], "index_version int, embedding_model string, embedding_dim int, build_time_s double")
    vectors.write.mode("overwrite").parquet(f"{folder}/docs")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """Checked vectors ``interaction_id, vector`` and the metadata."""
    meta = spark.read.parquet(f"{folder}/meta").first().asDict()
    if meta["index_version"] != 1 or not meta["embedding_model"] or meta["embedding_dim"] < 0:
        raise ContractError(f"{folder} is not an index of version 1")
    docs = spark.read.schema("interaction_id bigint, vector array<double>").parquet(f"{folder}/docs")
    gate(docs.where(contracts.vector(meta["embedding_dim"]).isNotNull()), "malformed vectors", "interaction_id")
    unique(docs, "interaction_id", "interaction_id")
    return docs, meta
