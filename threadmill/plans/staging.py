"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tempfile.TemporaryDirectory] = []


def stage_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one where none is configured, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.TemporaryDirectory(prefix="threadmill-stage-"))
            atexit.register(_OWN[0].cleanup)
        root = f"file://{_OWN[0].name}"
    return root.rstrip("/")


def stage_table(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table, cutting its lineage, and read it back; a filter on the columns ``by`` then reads their folders only."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/threadmill/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def session(app: str = "threadmill", **conf: str) -> SparkSession:
    """A session with the settings that results rely on: UTC, ANSI and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
