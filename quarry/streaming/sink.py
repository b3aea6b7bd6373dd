"""A file sink for ``foreachBatch`` in which a batch that runs again replaces what it wrote before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

BATCH = "batch_id"


def write_once(df: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda x: x, **options) -> StreamingQuery:
    """Starts the stream into a folder of Parquet files. ``change`` is any batch query on each batch, aggregates and joins too.

    Each batch is a partition named by its id, which rises in one checkpoint. Rows and id are committed in one job: files appear under the id
    with Spark's commit, and the batch's _SUCCESS after them. A batch that failed, or whose commit the checkpoint doesn't know, runs again with the same id and
    overwrites its own partition alone. ``committed`` reads the batches that have their _SUCCESS. One folder belongs to one checkpoint.
    """

    def put(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all whole batches, with their batch_id."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    found = top.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{BATCH}=*/_SUCCESS")) or []
    whole = [f.getPath().getParent().toString() for f in found]
    typed = StructType.fromDDL(f"{BATCH} long")
    if not whole:
        return spark.createDataFrame([], StructType([*schema, *typed]))
    full = StructType([*schema, *typed])
    return spark.read.schema(full).option("basePath", path).parquet(*whole).select(*(F.col(f"`{f.name}`") for f in full))
