"""Written intermediate tables in the folder that the cluster shares.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back: every
executor can read the parts, and a lost executor loses nothing that was committed.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one where none is configured, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _FALLBACK:
            holder = tempfile.TemporaryDirectory(prefix="threadmill-")
            atexit.register(holder.cleanup)
            _FALLBACK.append(holder.name)
        root = f"file://{_FALLBACK[0]}"
    return root.rstrip("/")


class Scratch:
    """A folder of written tables that belong to one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/threadmill/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def put(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the files."""
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str = "") -> None:
        """Delete a table that no later plan reads, or without a name all tables."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table) if table else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def plan_bytes(df: DataFrame) -> int:
    """Estimated input size of a plan in bytes, from file sizes; 0 where the plan has no estimate."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 55 else 0


def parts_for(df: DataFrame, mb: int = 24) -> int:
    """Number of partitions that keep about ``mb`` MB of input each; it grows with the input."""
    size = plan_bytes(df)
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(floor, 12), -(-size // (mb << 20)) if size else floor)
