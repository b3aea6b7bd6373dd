"""Exact percentiles of groups that may be of any size, by rounds that narrow down where the rank lies.

``percentile`` of Spark keeps all distinct values of a group in one task. Here each round cuts every open group's candidates at PIVOTS quantiles of them
(sketches, merged across tasks), counts exactly how many lie in each part, and goes on with the part that holds the rank. The sketch decides only how fast
candidates get fewer, by about PIVOTS a round; the counts decide the result. A group is closed when its part has one value, or FEW rows, which are then ranked.

Each round is two passes over the candidates of all open groups at once, and a table of one row a group in the shared folder. These run when the function is called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.staging import stage

#: Quantiles that a round cuts at, a power of two less one, and rows that are ranked directly.
PIVOTS, FEW = 255, 4096


def below(pivots: Column, value: Column) -> Column:
    """How many of the sorted pivots lie below the value, by binary search."""
    steps = F.array(*(F.lit((PIVOTS + 1) >> k) for k in range(1, (PIVOTS + 1).bit_length())))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(pivots, n + step - 1) < value, n + step).otherwise(n))


def select_rank(rows: DataFrame, ranks: DataFrame, few: int = FEW) -> DataFrame:
    """g, rank and value: the value at each group's rank, from 0. rows: g and v without nulls. ranks: a row for each g, with a rank that it has."""
    first = rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    state = stage(ranks.join(first, "g").select("g", "rank", "low", "high", "n", F.lit(0).cast("long").alias("under")), "ranks")
    while True:
        open_ = state.where((F.col("low") < F.col("high")) & (F.col("n") > few))
        if open_.isEmpty():
            break
        near = rows.join(open_, "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).select("g", "v", "rank", "under")
        pivots = stage(near.groupBy("g").agg(F.percentile_approx("v", [k / (PIVOTS + 1) for k in range(1, PIVOTS + 1)], 10_000).alias("pivots")), "pivots")
        # Parts in order of value: below a pivot, and equal to it. So a value that fills many quantiles is a part of its own.
        cut = near.join(pivots, "g").withColumn("part", below(F.col("pivots"), F.col("v")))
        cut = cut.withColumn("part", 2 * F.col("part") + F.coalesce((F.get("pivots", F.col("part")) == F.col("v")).cast("int"), F.lit(0)))
        parts = cut.groupBy("g", "rank", "under", "part").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
        upto = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # 2 * PIVOTS + 1 rows a group
        parts = parts.withColumn("upto", F.col("under") + F.sum("n").over(upto))
        held = parts.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        following = held.select("g", "rank", "low", "high", "n", (F.col("upto") - F.col("n")).alias("under"))
        state = stage(state.join(open_.select("g"), "g", "left_anti").union(following), "ranks")
    # One value, or few rows that are ranked.
    some = state.where("low < high")
    near = rows.join(some, "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    ranked = near.withColumn("place", F.col("under") + F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1).where("place = rank")
    return state.where("low = high").select("g", "rank", F.col("low").alias("value")).union(ranked.select("g", "rank", F.col("v").alias("value")))


def percentiles(df: DataFrame, by: Sequence[str], value: str, q: float, few: int = FEW) -> DataFrame:
    """The columns ``by`` and ``percentile``, a double: the exact q-th percentile, between two values in proportion. Nulls don't count; a group without values has a null.

    NaN is the largest value. Null keys are groups of their own.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be from 0 to 1")
    if "percentile" in by:
        raise ValueError("a column percentile is made here")
    all_rows = df.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v"))
    rows = all_rows.where(F.col("v").isNotNull())
    place = (F.col("n") - 1) * F.lit(float(q))
    ranks = rows.groupBy("g").agg(F.count("*").alias("n")).select("g", F.floor(place).cast("long").alias("rank"), (place - F.floor(place)).alias("part"))
    ranks = stage(ranks, "places")
    low = stage(select_rank(rows, ranks.select("g", "rank"), few), "low")
    # The next value: the same again if more rows reach it than its rank says, else the least above.
    around = rows.join(low, "g").groupBy("g", "rank", "value").agg(F.count(F.when(F.col("v") <= F.col("value"), 1)).alias("upto"), F.min(F.when(F.col("v") > F.col("value"), F.col("v"))).alias("above"))
    both = around.join(ranks.select("g", "part"), "g")
    high = F.when(F.col("upto") > F.col("rank") + 1, F.col("value")).otherwise(F.coalesce("above", "value"))
    found = both.select("g", F.when(F.col("part") == 0, F.col("value")).otherwise(F.col("value") + (high - F.col("value")) * F.col("part")).alias("percentile"))
    out = all_rows.select("g").distinct().join(found, "g", "left")
    return out.select(*(F.col(f"g.`{c}`").alias(c) for c in by), "percentile")
