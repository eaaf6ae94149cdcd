"""The verdict log as a stream: new files are read once, the latest record per key is kept, events are windowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.records import latest


def read_stream(spark: SparkSession, folder: str, schema: str, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def keep_latest(stream: DataFrame, key: str, seq: str, folder: str, checkpoint: str, merge_every: int = 50) -> StreamingQuery:
    """Every batch writes its own latest records as a part; a repeated batch writes its part anew. ``current`` reads the result.

    Every ``merge_every`` batches the parts become one table and are deleted, so a batch costs what it holds and a reader
    meets a bounded number of parts.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, epoch: int) -> None:
        latest(batch, key, seq).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/part-{epoch}")
        done = _tables(spark, folder, "all")
        if (epoch + 1) % merge_every == 0 and epoch not in done:
            current(spark, folder, batch.schema, key, seq).write.mode("overwrite").parquet(f"{folder}/all-{epoch}")
            for kind, n in [("all", n) for n in done] + [("part", n) for n in _tables(spark, folder, "part") if n <= epoch]:
                fs, path = _place(spark, f"{folder}/{kind}-{n}")
                fs.delete(path, True)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, schema: StructType | str, key: str, seq: str) -> DataFrame:
    """The latest record of each key that ``keep_latest`` has met."""
    whole = max(_tables(spark, folder, "all"), default=-1)
    paths = [f"{folder}/part-{n}" for n in _tables(spark, folder, "part") if n > whole] + ([f"{folder}/all-{whole}"] if whole >= 0 else [])
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return latest(rows, key, seq).select(*rows.columns)


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _tables(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """The numbers of the complete tables of a kind."""
    fs, path = _place(spark, f"{folder}/{kind}-*/_SUCCESS")
    return [int(f.getPath().getParent().getName().rpartition("-")[2]) for f in fs.globStatus(path) or []]


def windowed_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums per tumbling window and kind; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
