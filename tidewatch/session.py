"""Session helpers: settings read from Spark, and folders for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set up for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def work_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path for an intermediate table.

    The parent is the shared folder named by ``spark.checkpoint.dir``. Only a local
    session that names none falls back to a folder on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="tidewatch-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """The frame written once to the shared folder and read back, for plans that use it often."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
