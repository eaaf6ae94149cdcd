"""A corpus pipeline: each stage works on what the one before it kept.

The stages take (spark, docs, sf_dir) and return a DataFrame; each result is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.

Every stage works on rows: a row key, made where the stage begins, tells apart rows with null or repeated ids, so different texts never
stand for each other. Null and empty texts are documents without words: the classifier judges them like any other, near copies keep one of
them, no item is found in them, the mix gives them size 0 and the tokens are the end id alone. Of repeated rows near copies keep one. Ties are
settled by the smallest id, then by the row key. Very long texts are read whole. An empty table gives an empty result at each stage. Further
columns pass through, whatever their names: a stage carries the documents as one column ``row`` beside its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import decontaminate, mix_sources, near_copies, quality_fm
from threadmill.llm.queries import encoded, held_out
from threadmill.llm.scratch import Scratch

#: Documents stay from this probability of good quality on.
QUALITY = 0.3


def keyed(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``row``, the documents, and a ``row_key`` that no two rows share; written, so that it stays the same."""
    return scratch.put(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_key")), "keyed")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality_fm.train(docs, labels, learn=~held_out(5))
    return quality_fm.score(docs, model).where(F.col("score") >= QUALITY).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity of 0.8 or more, through chains) the document with the smallest id stays."""
    scratch = Scratch(spark, "near-duplicates")
    own = keyed(scratch, docs)
    work = Scratch(spark, "near-copies")
    gone = scratch.put(near_copies.gone(own.select("row_key", "row.doc_id", "row.text"), work), "gone")
    work.drop()
    return own.join(gone, "row_key", "left_anti").select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    scratch = Scratch(spark, "contaminated")
    own = keyed(scratch, docs)
    work = Scratch(spark, "decontaminate")
    found = scratch.put(decontaminate.contaminated_ids(own.select("row_key", "row.text"), items, "row_key", work), "found")
    work.drop()
    return own.join(found, "row_key", "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    own = keyed(Scratch(spark, "mixed"), docs)
    taken = mix_sources.mix(own.select("row_key", "row.doc_id", "row.text", "row.source"), key_col="row_key").where("copies > 0")
    taken = taken.select("row_key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("time"))
    return own.join(taken, "row_key").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the token files."""
    return encoded(spark, docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("tokens", tokens),
]

#: A factorisation machine and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir) if k == len(STAGES) - 1 else scratch.put(stage(spark, docs, sf_dir), name)
        if k > 1:
            scratch.drop(STAGES[k - 2][0])
    return docs
