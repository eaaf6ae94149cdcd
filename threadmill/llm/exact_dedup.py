"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a Parquet table, bucketed and sorted by digest. A batch is reduced to one row per digest with
two-level (salted) aggregation, so that a text which makes up a third of all rows never meets in one task;
the reduced batch is anti-joined to the index by sort-merge join (the index side needs no shuffle) and the
digests that are new are appended.

Null texts count as empty; an empty batch gives no rows; repeated rows count as often as they occur; ties
cannot arise, for the largest id of equal texts stays and rows with the same id are equal (all of them are
then marked as kept); null ids rank below any other id. Further columns of the input are ignored.

The index folder holds ``digests`` (the table) and ``meta`` (how many buckets it has): an index that is opened again takes its own
bucket count, and another one that is asked for is refused. Digests are appended with the name of their batch, and a batch that is
added again under its name (a retry) meets only digests of other batches, so it gets the same answer and is not appended twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, exists

SALTS = 64


class DigestIndex:
    """Digests of all texts seen so far, with the id that was kept for each.

    ``path`` is the place of the index; one written by an earlier session is opened again by its path.
    ``buckets`` is fixed when the index is created (64 if not given) and should suit its final size.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.scratch = Scratch(spark, "exact-dedup")
        self.path = path or self.scratch.path("index")
        self.table = f"threadmill_digests_{uuid.uuid4().hex[:12]}"
        meta = f"{self.path}/meta"
        if exists(spark, f"{meta}/_SUCCESS"):
            own = spark.read.schema("buckets int").parquet(meta).first()[0]
            if buckets not in (None, own):
                raise ValueError(f"the index at {self.path} has {own} buckets, not {buckets}")
        else:
            own = buckets or 64
            spark.range(1).select(F.lit(own).cast("int").alias("buckets")).write.mode("overwrite").parquet(meta)
        self.buckets = own
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {own} BUCKETS LOCATION '{self.path}/digests'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forget the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str | None = None) -> DataFrame:
        """Decide each row of a batch and append its new digests. A batch that may be tried again has a ``name``.

        Returns ``doc_id, keep_id, group_size, kept, digest``: ``group_size`` counts the rows of the batch with
        this text; a text that the index already has keeps nothing of the batch and ``keep_id`` is the older id.
        """
        run = uuid.uuid4().hex[:8]
        name = name or run
        mine = F.col("batch") == name
        rows = self.scratch.put(
            batch.select(
                F.col(id_col).cast("long").alias("doc_id"),
                F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
                F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"),
            ),
            f"rows-{run}",
        )
        parts = rows.groupBy("digest", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
        groups = parts.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")
        )
        groups = self.scratch.put(groups, f"groups-{run}")
        known = self.read().where(~mine)
        new = groups.select("digest", "keep_id").hint("merge").join(known.hint("merge"), "digest", "left_anti")
        old = known.select("digest", F.col("keep_id").alias("old_id")).hint("merge")
        judged = self.scratch.put(
            groups.join(old, "digest", "left").select("digest", "keep_id", "old_id", "group_size", F.explode("salts").alias("salt")),
            f"judged-{run}",
        )
        # What an earlier try has appended is there already.
        new = new.hint("merge").join(self.read().where(mine).select("digest").hint("merge"), "digest", "left_anti")
        new = self.scratch.put(new, f"new-{run}")  # the anti-joins are complete before the table they read is appended to
        new = new.select("digest", "keep_id", F.lit(name).alias("batch"))
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        for table in (f"groups-{run}", f"new-{run}"):
            self.scratch.drop(table)
        return rows.join(judged, ["digest", "salt"]).select(
            "doc_id",
            F.coalesce("old_id", "keep_id").alias("keep_id"),
            "group_size",
            (F.col("old_id").isNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "digest",
        )
