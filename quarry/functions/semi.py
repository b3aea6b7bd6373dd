"""Columns of JSON text as VARIANT: parsed once, read by path, with a schema found by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def parsed(c: str | Column) -> Column:
    """The text as a variant; null where it's null or malformed."""
    return F.try_parse_json(c)


def at(variant: str | Column, path: str, kind: str) -> Column:
    """The value at a path such as $.a.b[0], as a type; null where there's none or it doesn't fit."""
    return F.try_variant_get(variant, path, kind)


def malformed(text: str, variant: str) -> Column:
    """Whether there is a text that isn't JSON."""
    return F.col(text).isNotNull() & F.col(variant).isNull()


def schema_of(df: DataFrame, variant: str, *by: str) -> DataFrame:
    """One schema that holds all values of the column, for each group: types are widened, and what doesn't fit one type stays a variant."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(variant).alias("schema"))


def entries(df: DataFrame, variant: str) -> DataFrame:
    """A row for each key of an object, or place of an array: pos, key, value. Rows with other values have none."""
    t = F.col(variant)
    return df.lateralJoin(_exploded(df, t))


def _exploded(df: DataFrame, variant: Column) -> DataFrame:
    return df.sparkSession.tvf.variant_explode(variant.outer())
