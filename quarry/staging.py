"""Intermediate tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it's unset, a new local folder, on a local master alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quarry-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written to the shared folder and read back; it goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top)
    return spark.read.schema(df.schema).parquet(path)
