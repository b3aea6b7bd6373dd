"""Exact distinct counts that add up: bitmaps of ids, stored once by group and merged up any rollup of it.

A count can't be summed over days, as days share users; a bitmap can be merged. Ids (longs) fall into buckets of 32,768; each (group, bucket) has
one bitmap of 4 kB, made by partial aggregation, so a group of any size is spread over its buckets. Bitmaps of a bucket are OR-ed; counts of buckets are summed, since
buckets share no id. Stored rows never need the events again, and a new day is appended to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BUCKET, BITS = "id_bucket", "id_bits"


def distinct_bitmaps(df: DataFrame, by: Sequence[str | Column], value: str) -> DataFrame:
    """A row for each group and bucket of ids: the columns ``by``, id_bucket, id_bits. Null ids don't count; negative ones do; null keys are a group."""
    own = F.col(value).cast("long")
    # Spark's bucket and position hold for positive ids: others are told apart by a sign of the bucket.
    positive = F.when(own > 0, own).otherwise(-own + 1)
    bucket = F.when(own > 0, F.bitmap_bucket_number(positive)).otherwise(-F.bitmap_bucket_number(positive))
    rows = df.where(own.isNotNull()).select(*by, bucket.alias(BUCKET), F.bitmap_bit_position(positive).alias("id_position"))
    keys = [c for c in rows.columns if c not in (BUCKET, "id_position")]
    return rows.groupBy(*keys, BUCKET).agg(F.bitmap_construct_agg("id_position").alias(BITS))


def merged(bitmaps: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Bitmaps of coarser groups, from those of finer ones."""
    rows = bitmaps.select(*by, BUCKET, BITS)
    return rows.groupBy(*(c for c in rows.columns if c != BITS)).agg(F.bitmap_or_agg(BITS).alias(BITS))


def distinct_counts(bitmaps: DataFrame, by: Sequence[str | Column], name: str = "n_distinct") -> DataFrame:
    """The exact number of distinct ids of each group of ``by``, which may be any columns of the stored rows or expressions on them."""
    each = merged(bitmaps, by)
    return each.groupBy(*(c for c in each.columns if c not in (BUCKET, BITS))).agg(F.sum(F.bitmap_count(BITS)).alias(name))
