"""The folder that driver and executors share, and lineage that ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder serves a local master; on a cluster that is an error, as each
    executor would write to a disk of its own."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        there = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """Written as Parquet in the shared folder and read back. A checkpoint would keep Spark's guess of the size, which a join multiplies:
    in a loop of joins its digits double every round, until planning takes longer than the work. Files have the size they have."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kerbline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
