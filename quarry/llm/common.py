"""Shared folder, intermediate tables and small helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one, on a local master alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir() or at
    return at.rstrip("/")


#: Spark's setting to delete a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Parts over which the rows of a hot key are dealt.
SALTS = 256


def attach(rows: DataFrame, values: DataFrame, by: list[str], own: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with ``values``, which has few rows for each key. No key is one task's: rows are dealt over salts by ``own``, values to those that occur.

    Where Spark's own size of ``values`` lets it send them around, it's a plain join, and rows stay where they are.
    """
    session = rows.sparkSession._jsparkSession.sessionState().conf()
    if int(values._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= session.autoBroadcastJoinThreshold():
        return rows.join(values, by, how)
    salt = "salt"
    while salt in rows.columns:
        salt += "_"
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(own), F.lit(SALTS)))
    there = dealt.select(*by, salt).distinct().join(values, by)
    return dealt.join(there, [*by, salt], how).drop(salt)


#: Bits of a bitmap at most: 131,072 words of 64 bits, some 2 MB, are sent around whatever the input.
BITS = 2**23


def marked(work: Workspace, rows: DataFrame, key: Column, hashes: DataFrame, name: str) -> DataFrame:
    """rows with a boolean ``name``: false only where no row of ``hashes`` (a 64-bit ``hash``) equals the key.

    A bitmap of 16 bits a hash, BITS at most, is broadcast. Of other rows one in 16 is marked too, and more where hashes pass BITS / 16: it saves a shuffle of what it clears, and
    clears less and less of a corpus whose hashes are many more than that. The result of a join after it is the same.
    """
    own = work.put(hashes, "hashes")
    bits = F.lit(min(BITS, max(64, 1 << (16 * own.count()).bit_length())))
    places = own.select(F.pmod("hash", bits).alias("bit"))
    words = places.groupBy(F.floor(F.col("bit") / 64).alias(f"{name}_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias(f"{name}_bits"))
    place = F.pmod(key, bits)
    met = rows.withColumn(f"{name}_at", place).withColumn(f"{name}_word", F.floor(F.col(f"{name}_at") / 64))
    met = met.join(F.broadcast(work.put(words, "bitmap")), f"{name}_word", "left")
    one = F.call_function("shiftright", F.coalesce(f"{name}_bits", F.lit(0).cast("long")), F.pmod(F.col(f"{name}_at"), F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return met.withColumn(name, one == 1).select(*(f"`{c}`" for c in rows.columns), name)


class Workspace:
    """Intermediate tables as Parquet in the shared folder: they cut the lineage, and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}-{name}"
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP)
        conf.set(CLEANUP, "true")  # what was shuffled for this table isn't read again
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(CLEANUP, before)
        if self.n == 1:  # what no one drops goes with the driver's process
            top = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
            top.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(top)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quarry_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables of put() that no later query reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._quarry_path)
            path.getFileSystem(conf).delete(path, True)


def text_bytes(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and text as UTF-8 bytes; a null text is empty."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
