"""Joins, windows and top-k that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.distinct import distinct_bitmaps, distinct_counts, merged
from quarry.operators.intervals import overlap_join, range_join
from quarry.operators.nearest import knn_join
from quarry.operators.scan import asof_join, counts_within, ntile, positions, sessions
from quarry.operators.selection import percentiles

__all__ = ["asof_join", "counts_within", "distinct_bitmaps", "distinct_counts", "knn_join", "merged", "ntile", "overlap_join", "percentiles", "positions", "range_join", "salted_distinct", "sessions", "top_k"]


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark cuts each task's groups to k rows before it shuffles."""
    if "rank" in df.columns:
        raise ValueError("top_k adds a column rank")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def salted_distinct(df: DataFrame, by: Sequence[str], value: Column, salts: int = 64) -> DataFrame:
    """Counts of distinct values and of all where one key may hold most rows: distinct values are spread over salts first."""
    salted = df.select(*by, value.alias("v")).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)))
    part = salted.groupBy(*by, "salt").agg(F.count_distinct("v").alias("d"), F.count("v").alias("n"))
    return part.groupBy(*by).agg(F.sum("d").alias("n_distinct"), F.sum("n").alias("n"))
