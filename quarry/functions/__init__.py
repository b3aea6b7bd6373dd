"""Column functions that both the queries and their users need."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def money(c: str | Column) -> Column:
    """A price as a decimal: exact in any order of summation, unlike the stored double."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def discounted(price: str, discount: str) -> Column:
    return money(price) * (F.lit(1).cast("decimal(18,2)") - money(discount))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two arrays of numbers, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def json_int(c: str, key: str) -> Column:
    return F.get_json_object(c, f"$.{key}").cast("long")


def trunc(unit: str, ts: str) -> Column:
    """date_trunc that keeps a time without zone as it is."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")
