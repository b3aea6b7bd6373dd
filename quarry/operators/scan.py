"""Scans along a key's time that no key's whole history has to share a task for.

A key of FEW rows at most stays whole. For the others time is cut into slices by quantiles over their rows, so a key with most rows spreads over most slices. Each (key, slice) is scanned by itself; what
it hands on (a last value, a count, an open session) is one row, so a key has at most as many of those as there are slices. They are
scanned by key and put before the slices' own results. Rows move once, by key and slice; then only the summaries move.

So summaries are few: one for each usual key, and SLICES at most for each of the large keys, which are counted first (rows / FEW of them at most; they are sent around).
The quantiles are a subquery of the same query: nothing runs when it is built. Rows of one key and instant share a slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Slices of time, a power of two. A key's rows go to so many tasks at most.
SLICES = 1024
#: Rows of a key that are one task's.
FEW = 100_000


def same(a: str, b: str, names: Sequence[str]) -> Column:
    """Equality of columns of two aliased sides, null equal to null."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names), F.lit(True))


def large(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The keys with more than FEW rows, as columns large_0 and on."""
    names = [f"large_{k}" for k in range(len(by))]
    return F.broadcast(df.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True))).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(*names))


def is_large(by: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"large_{k}")) for k, c in enumerate(by)))


def sliced(df: DataFrame, at: str, slices: int = SLICES, name: str = "slice", by: Sequence[str] = ()) -> DataFrame:
    """df with the number of the slice that its time is in; slices rise with time. With ``by``, keys of few rows are in slice 0 alone."""
    if slices < 2 or slices & (slices - 1):
        raise ValueError("slices must be a power of two")
    cut = df.join(large(df, by), is_large(by), "left_semi") if by else df
    bounds = cut.agg(F.percentile_approx(at, [k / slices for k in range(1, slices)], 10_000).alias("b")).scalar()
    steps = F.array(*(F.lit(slices >> k) for k in range(1, slices.bit_length())))
    # Binary search: how many bounds lie below the time.
    number = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(F.col(f"{name}_bounds"), n + step - 1) < F.col(at), n + step).otherwise(n))
    if by:
        df = df.join(large(df, by).withColumn("large", F.lit(True)), is_large(by), "left").select(*(f"`{c}`" for c in df.columns), "large")
        return df.withColumn(f"{name}_bounds", bounds).withColumn(name, F.when(F.col("large"), number).otherwise(0)).drop(f"{name}_bounds", "large")
    return df.withColumn(f"{name}_bounds", bounds).withColumn(name, number).drop(f"{name}_bounds")


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, take: Sequence[str], tie: str, slices: int = SLICES) -> DataFrame:
    """Each left row with the columns ``take`` of the last right row at or before it with equal keys; null if there is none.

    Both sides are sorted together by (key, slice, time) and scanned for the last value: linear in rows, where an inequality
    join is quadratic in a key's rows. Right rows at the left row's time count as before; of those the last by ``tie``.
    Right rows with null keys or times match nothing; such left rows are kept with nulls.
    """
    own, keys = list(left.columns), [f"k_{k}" for k in range(len(on))]
    there = lambda df, names: reduce(lambda x, y: x & y, (df[c].isNotNull() for c in names))
    known, found = right.where(there(right, [right_at, *on])), left.where(there(left, [left_at, *on]))
    lost = left.where(~there(left, [left_at, *on]))
    hit = F.struct(*[F.col(c).alias(f"r_{k}") for k, c in enumerate(take)])
    a = found.select(*[F.col(c).alias(f"l_{k}") for k, c in enumerate(own)], *[F.col(c).alias(k) for k, c in zip(keys, on, strict=True)], F.col(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[tie].dataType).alias("tie"))
    b = known.select(*[F.lit(None).cast(left.schema[c].dataType).alias(f"l_{k}") for k, c in enumerate(own)], *[F.col(c).cast(left.schema[c].dataType).alias(k) for k, c in zip(keys, on, strict=True)], F.col(right_at).alias("at"), F.lit(0).alias("side"), F.col(tie).alias("tie"), hit.alias("hit"))
    both = sliced(a.withColumn("hit", F.lit(None).cast(b.schema["hit"].dataType)).unionByName(b), "at", slices, by=keys)
    order = Window.partitionBy(*keys, "slice").orderBy("at", "side", "tie")
    local = both.withColumns({"hit": F.last("hit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "final": F.lead("side").over(order).isNull()})
    # The last value of each (key, slice), carried to the slices after it.
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = local.where("final").select(*keys, "slice", F.last("hit", ignorenulls=True).over(before).alias("carried"))
    got = local.where("side = 1").join(carried, [*keys, "slice"]).withColumn("hit", F.coalesce("hit", "carried"))
    out = got.select(*[F.col(f"l_{k}").alias(c) for k, c in enumerate(own)], *[F.col(f"hit.r_{k}").alias(c) for k, c in enumerate(take)])
    return out.union(lost.select(*own, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take]))


def sessions(df: DataFrame, by: str, at: str, gap: str, slices: int = SLICES) -> DataFrame:
    """Runs of rows less than ``gap`` apart: key, session_start, session_end, n. Null keys are one key; rows without a time are in no session.

    Sessions are found within each slice. Only the first and the last of a slice can go on in another: those, two for each slice, are joined by key.
    """
    rows = sliced(df.where(F.col(at).isNotNull()).select(F.col(by).alias("k"), F.col(at).alias("at")), "at", slices, by=["k"])
    apart = lambda a, b: F.coalesce(a - b >= F.expr(f"interval {gap}"), F.lit(True))
    order = Window.partitionBy("k", "slice").orderBy("at")
    run = F.sum(apart(F.col("at"), F.lag("at").over(order)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    local = rows.withColumn("run", run).groupBy("k", "slice", "run").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n"))
    local = local.withColumn("edge", (F.col("run") == 1) | (F.col("run") == F.max("run").over(Window.partitionBy("k", "slice"))))
    by_key = Window.partitionBy("k").orderBy("low")
    ends = local.where("edge").withColumn("new", apart(F.col("low"), F.lag("high").over(by_key)).cast("long"))
    ends = ends.withColumn("run", F.sum("new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    whole = ends.groupBy("k", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    columns = [F.col("k").alias(by), F.col("low").alias("session_start"), F.col("high").alias("session_end"), "n"]
    return local.where("NOT edge").select(*columns).union(whole.select(*columns))


def positions(df: DataFrame, by: str, at: str, tie: str, value: str, slices: int = SLICES) -> DataFrame:
    """df with, along each key's time: row and rank (from 1), total (the key's rows), and before (``value`` of the row before).

    Rows at one time rank alike and stand in order of ``tie``. Null times come first, null keys are one key.
    """
    taken = {"row", "rank", "total", "before", "slice"} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here")
    # Keys of few rows are whole in one task and need nothing carried.
    usual = df.join(large(df, [by]), is_large([by]), "left_anti")
    key = Window.partitionBy(by).orderBy(at, tie)
    usual = usual.withColumns({"row": F.row_number().over(key).cast("long"), "before": F.lag(value).over(key)}).withColumn("rank", F.min("row").over(Window.partitionBy(by, at))).withColumn("total", F.count("*").over(Window.partitionBy(by)))
    columns, df = df.columns, df.join(large(df, [by]), is_large([by]), "left_semi")
    order = Window.partitionBy(by, "slice").orderBy(at, tie)
    last = F.struct(F.col(value).alias("v"))
    local = sliced(df, at, slices).withColumns({"row": F.row_number().over(order).cast("long"), "rank": F.rank().over(Window.partitionBy(by, "slice").orderBy(at)).cast("long"), "last": F.lag(last).over(order), "final": F.lead(F.lit(1)).over(order).isNull()})
    ends = local.where("final").select(by, "slice", F.col("row").alias("n"), last.alias("held"))
    key = Window.partitionBy(by)
    before = key.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(by, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.last("held", ignorenulls=True).over(before).alias("held"), F.sum("n").over(key).alias("total"))
    got = local.alias("a").join(carried.alias("b"), same("a", "b", [by, "slice"]))
    got = got.select(*(F.col(f"a.`{c}`") for c in columns), (F.col("row") + F.col("first")).alias("row"), (F.col("rank") + F.col("first")).alias("rank"), "total", F.coalesce("last", "held")["v"].alias("before"))
    return usual.select(*(f"`{c}`" for c in columns), "row", "rank", "total", "before").union(got)


def ntile(n: int, row: str = "row", total: str = "total") -> Column:
    """The number of the row's part where the rows of a key are cut into n parts, the larger ones first."""
    size, more = F.floor(F.col(total) / n), F.pmod(F.col(total), F.lit(n))
    edge = more * (size + 1)
    return F.when(F.col(row) <= edge, F.floor((F.col(row) - 1) / (size + 1))).otherwise(more + F.floor((F.col(row) - 1 - edge) / F.greatest(size, F.lit(1)))).cast("long") + 1


def counts_within(df: DataFrame, by: str, at: str, span: str, name: str, slices: int = SLICES) -> DataFrame:
    """df with the number of the key's rows from ``span`` before the row's time up to it, both included; null without a time or key.

    Counts up to each instant, once at the row's time and once just before the span; microseconds are the least step of time.
    """
    taken = {"within_copy", "within_place", "within_up_to", "within_made"} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here")
    there = F.col(at).isNotNull() & F.col(by).isNotNull()
    known, columns = df.where(there), df.columns
    # Keys of few rows: each row stands at its time and just before its span, and both copies know how many rows there are up to there.
    usual = known.join(large(known, [by]), is_large([by]), "left_anti").withColumn("within_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    usual = usual.withColumn("within_place", F.when(F.col("within_copy") == 0, F.col(at)).otherwise(F.expr(f"`{at}` - interval {span} - interval 1 microsecond")))
    usual = usual.withColumn("within_up_to", F.sum(1 - F.col("within_copy")).over(Window.partitionBy(by).orderBy("within_place").rangeBetween(Window.unboundedPreceding, 0)))
    instant = Window.partitionBy(by, at)
    usual = usual.withColumn("within_made", F.max("within_up_to").over(instant) - F.coalesce(F.min("within_up_to").over(instant), F.lit(0))).where("within_copy = 0").select(*(f"`{c}`" for c in columns), F.col("within_made").cast("long").alias(name))
    lost = df.where(~there).select(*(f"`{c}`" for c in columns), F.lit(None).cast("long").alias(name))
    df = known.join(large(known, [by]), is_large([by]), "left_semi")
    instants = df.groupBy(F.col(by).alias("k"), F.col(at).alias("at")).agg(F.count("*").alias("n"))
    rows = sliced(instants, "at", slices)
    order = Window.partitionBy("k", "slice").orderBy("at")
    local = rows.withColumns({"up_to": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "final": F.lead("n").over(order).isNull()})
    before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = local.where("final").select("k", "slice", F.coalesce(F.sum("up_to").over(before), F.lit(0)).alias("first"))
    counts = local.join(carried, ["k", "slice"]).select("k", "at", (F.col("up_to") + F.col("first")).alias("up_to"))
    starts = counts.withColumn("since", F.expr(f"at - interval {span} - interval 1 microsecond"))
    earlier = counts.select("k", F.col("at").alias("seen"), F.col("up_to").alias("gone"))
    each = asof_join(starts, earlier, ["k"], "since", "seen", ["gone"], "gone", slices)
    found = each.select("k", "at", (F.col("up_to") - F.coalesce("gone", F.lit(0))).alias(name))
    many = df.alias("a").join(found.alias("b"), (F.col(f"a.{by}") == F.col("b.k")) & (F.col(f"a.{at}") == F.col("b.at")), "left").select("a.*", F.col(f"b.{name}"))
    return usual.union(many).union(lost)
