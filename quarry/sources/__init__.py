"""Sources and sinks: the table folder, and a round trip through Spark's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FORMATS = ("parquet", "orc", "json", "csv")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet files; columns and filters reach the scan."""
    if name not in TABLES:
        raise KeyError(f"no table {name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """Tables as temporary views of their names."""
    for name in names or TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)


def write(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    if form not in FORMATS:
        raise ValueError(f"no format {form}")
    out = df.write.mode(mode).partitionBy(*partition_by)
    (out.option("header", True) if form == "csv" else out).format(form).save(path)


def read(spark: SparkSession, path: str, schema: StructType, form: str = "parquet") -> DataFrame:
    """With a given schema: nothing is inferred, so no extra pass over the data."""
    source = spark.read.schema(schema)
    return (source.option("header", True) if form == "csv" else source).format(form).load(path)


def stream(spark: SparkSession, folder: str, name: str, per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream, so many for each trigger."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
