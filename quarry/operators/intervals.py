"""Joins on ranges: points in intervals, and intervals that overlap. Equality joins on buckets, then the exact condition.

An interval goes to a level whose buckets are at least as long as it is, so it lies in two or three of them, whatever its length; levels are a factor of 16 apart.
What meets it is looked for on each level that occurs, which a subquery of the same query tells: no job runs while a query is built.

A bucket with more rows than a task should have is dealt: each side's rows into chunks, each pair of chunks a group of its own.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.scan import SLICES, sliced
from quarry.staging import stage

#: Levels are this factor apart. Rows of a bucket's chunk.
FACTOR, CHUNK = 16, 20_000
#: Starts in order that are one row. Pairs, and rows of either side, that are one task's, about. Tasks at most; beyond, each has more.
RUN, PAIRS, ROWS, TASKS = 1024, 4_000_000, 100_000, 10_000
MADE = ("span_level", "span_bucket", "span_chunk", "span_other", "own_from", "own_to", "own_level", "from_a", "from_b", "level_a", "level_b")


def position(df: DataFrame, c: str) -> Column:
    """A number as a double, a time as seconds: what ``width`` is in. Only buckets come from it; conditions use the columns themselves."""
    kind = df.schema[c].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        # Days and the time of day, so that no zone's clock changes make it fall.
        day = F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("double") * 86_400
        return day if kind == "date" else day + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), F.col(c)).cast("double")
    return F.col(c).cast("double")


def bucket(at: Column, level: Column, width: float) -> Column:
    return F.floor(at / (F.lit(float(width)) * F.pow(F.lit(float(FACTOR)), level)))


def level(length: Column, width: float) -> Column:
    """The level whose buckets an interval of this length spans two of at most (three, where a quotient is rounded)."""
    return F.ceil(F.log2(F.greatest(F.lit(1.0), length / width)) / 4).cast("int")


def checked(width: float, *sides: DataFrame) -> None:
    if not width > 0:
        raise ValueError("width must be positive")
    if set(MADE) & {c for s in sides for c in s.columns}:
        raise ValueError(f"columns {MADE} are made here")


def dealt_join(a: DataFrame, b: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Inner join on ``keys`` in which a key with many rows on a side is dealt over a grid of chunks, each pair of chunks once.

    Keys with over ``chunk`` rows on a side are counted first, and only those. Chunks are dealt by a random number of a row, so equal rows spread too.
    """
    counted = lambda x, name: x.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > chunk)
    hot = counted(a, "na").join(counted(b, "nb"), keys, "full_outer").select(*keys, F.ceil(F.coalesce("na", F.lit(1)) / chunk).cast("int").alias("na"), F.ceil(F.coalesce("nb", F.lit(1)) / chunk).cast("int").alias("nb"))

    def dealt(x: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        n, m = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        y = x.join(hot, keys, "left").withColumn(mine, F.floor(F.rand(7) * n).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), m - 1)))
        return y.drop("na", "nb")

    left, right = dealt(a, "na", "nb", "span_chunk", "span_other"), dealt(b, "nb", "na", "span_other", "span_chunk")
    return left.join(right, [*keys, "span_chunk", "span_other"]).drop("span_chunk", "span_other")


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, chunk: int = CHUNK) -> DataFrame:
    """Points in [start, end) of spans, all columns of both, whose names must differ. A width near the usual length of spans is right.

    A pair meets in one bucket alone, so nothing comes twice. Null bounds and points match nothing; an empty span neither.
    """
    checked(width, points, spans)
    full = spans.where(F.col(start) < F.col(end))
    low, high, here = position(spans, start), position(spans, end), position(points, at)
    cut = full.withColumn("span_level", level(high - low, width))
    levels = cut.agg(F.collect_set("span_level")).scalar()
    cut = cut.withColumn("span_bucket", F.explode(F.sequence(bucket(low, F.col("span_level"), width), bucket(high, F.col("span_level"), width))))
    each = points.where(F.col(at).isNotNull()).withColumn("span_level", F.explode(levels)).withColumn("span_bucket", bucket(here, F.col("span_level"), width))
    met = dealt_join(each, cut, ["span_level", "span_bucket"], chunk)
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("span_level", "span_bucket")


def numbered(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Each interval of either side (0 left, 1 right), its columns as l_0 or r_0 and on; number: that of its start among its side's, from 0; low, high: which of the other side's starts lie in it.

    Those are the numbers from low up to high, without high. Starts at one place: a left interval holds a right one's, not the reverse. An interval whose end isn't after its start holds none.
    All bounds are sorted together within slices of their places and counted; the counts of whole slices are carried. So bounds of one place share a task, nothing more.
    """
    names = [[f"{side}_{k}" for k in range(len(df.columns))] for side, df in (("l", left), ("r", right))]

    def bounds(df: DataFrame, low: str, high: str, side: int) -> DataFrame:
        # At one place ends come first, then left starts, then right ones.
        both = F.array(F.struct(F.col(low).alias("place"), F.lit(1 + side).alias("kind")), F.struct(F.col(high).alias("place"), F.lit(0).alias("kind")))
        one = df.select(F.lit(side).alias("side"), F.monotonically_increasing_id().alias("id"), both.alias("bounds"), *(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names[side], strict=True)))
        return one.select("side", "id", F.inline("bounds"), *names[side]).withColumns({n: F.when(F.col("kind") > 0, F.col(n)) for n in names[side]})

    rows = sliced(bounds(left, *a, 0).unionByName(bounds(right, *b, 1), allowMissingColumns=True), "place")
    order = Window.partitionBy("slice").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"lefts": F.sum((F.col("kind") == 1).cast("long")).over(order), "rights": F.sum((F.col("kind") == 2).cast("long")).over(order)})
    starts, own, others = F.col("kind") > 0, F.when(F.col("side") == 0, F.col("lefts")).otherwise(F.col("rights")), F.when(F.col("side") == 0, F.col("rights")).otherwise(F.col("lefts"))
    at = {"from_slice": F.when(starts, F.col("slice")), "to_slice": F.when(~starts, F.col("slice")), "number": F.when(starts, own - 1), "low": F.when(starts, others), "high": F.when(~starts, others)}
    held = stage(rows.groupBy("side", "id").agg(*(F.max(c).alias(n) for n, c in at.items()), *(F.first(n, True).alias(n) for n in names[0] + names[1])), "intervals")
    # Starts in the slices before each: one count a slice and side, so they are constants.
    starts = {r["slice"]: r for r in held.groupBy(F.col("from_slice").alias("slice")).agg(F.count_if(F.col("side") == 0).alias("lefts"), F.count_if(F.col("side") == 1).alias("rights")).collect()}
    sums = lambda n: accumulate((starts[k][n] if k in starts else 0 for k in range(SLICES - 1)), initial=0)
    lefts, rights = (F.split(F.lit(",".join(map(str, sums(n)))), ",").cast("array<bigint>") for n in ("lefts", "rights"))
    before = lambda c, x, y: F.when(F.col("side") == 0, F.get(x, F.col(c))).otherwise(F.get(y, F.col(c)))
    out = {"number": before("from_slice", lefts, rights), "low": before("from_slice", rights, lefts), "high": before("to_slice", rights, lefts)}
    return held.select("side", *((F.col(n) + c).alias(n) for n, c in out.items()), *names[0], *names[1])


def met_in_runs(spans: DataFrame, points: DataFrame, own: list[str], theirs: list[str], parts: int, chunk: int) -> DataFrame:
    """Each span with each point numbered from its low up to its high: ``own`` of the one and ``theirs`` of the other.

    RUN points in their order are one row. A span meets each run that it touches, once, and reads off by number what it holds of it: no candidate fails. A run that over ``chunk`` spans
    touch is dealt with them. The number of partitions is given, as that of the pairs doesn't show in the rows that go in.
    """
    run = lambda c: F.floor(c / RUN)
    number = (F.col("number") % RUN).cast("int")
    runs = points.groupBy(run(F.col("number")).alias("run")).agg(F.array_sort(F.collect_list(F.struct(number.alias("k"), F.struct(*theirs).alias("point"))), lambda x, y: x["k"] - y["k"]).alias("points"))
    runs = runs.select("run", F.transform("points", lambda x: x["point"]).alias("points"))
    cut = spans.where("low < high").select("low", "high", *own, F.explode(F.sequence(run(F.col("low")), run(F.col("high") - 1))).alias("run"))
    cut = cut.withColumns({"low": F.greatest(F.col("low") - F.col("run") * RUN, F.lit(0)).cast("int"), "high": F.least(F.col("high") - F.col("run") * RUN, F.lit(RUN)).cast("int") - 1})
    hot = F.broadcast(cut.groupBy("run").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).where("chunks > 1"))
    dealt = lambda df, chunk: df.join(hot, "run", "left").withColumn("chunk", chunk(F.coalesce("chunks", F.lit(1)))).drop("chunks").repartition(parts, "run", "chunk")
    met = dealt(cut, lambda n: F.floor(F.rand(7) * n).cast("int")).join(dealt(runs, lambda n: F.explode(F.sequence(F.lit(0), n - 1))), ["run", "chunk"])
    met = met.select(*own, "points", F.explode(F.sequence("low", "high")).alias("k"))
    return met.select(*own, *(F.get("points", F.col("k"))[n].alias(n) for n in theirs))


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], width: float, chunk: int = CHUNK, compared: bool = False) -> DataFrame:
    """Pairs of intervals [start, end) that overlap, each once, all columns of both, whose names must differ. Nothing depends on ``width`` any more; callers still give it.

    The later start of two that overlap lies in the other one. Starts are numbered, so those that an interval holds are a stretch of numbers, and work grows with rows and pairs alone.
    Null bounds match nothing. Empty intervals neither, unless ``compared``: then pairs are those of the two comparisons alone, start < other's end both ways, as in
    SQL without a condition on either side. So an interval whose end isn't after its start matches what holds both its bounds inside; it is met by its start.

    The numbers are stored and the pairs counted while the query is built. Long columns are better joined on afterwards: RUN rows of a side are one.
    """
    checked(width, left, right)
    (low_a, high_a), (low_b, high_b) = a, b
    there = lambda low, high: F.col(low).isNotNull() & F.col(high).isNotNull() if compared else F.col(low) < F.col(high)
    rows = numbered(left.where(there(*a)), right.where(there(*b)), a, b)
    sides = {r["side"]: r for r in rows.groupBy("side").agg(F.count("*").alias("rows"), F.sum(F.greatest(F.col("high") - F.col("low"), F.lit(0))).alias("pairs")).collect()}
    parts = lambda side: min(TASKS, 1 + sum(r["rows"] for r in sides.values()) // ROWS + (sides[side]["pairs"] // PAIRS if side in sides else 0))
    lefts, rights = ([c for c in rows.columns if c.startswith(side)] for side in ("l_", "r_"))
    x, y = rows.where("side = 0"), rows.where("side = 1")
    out = [met_in_runs(x, y, lefts, rights, parts(0), chunk), met_in_runs(y, x, rights, lefts, parts(1), chunk)]
    columns = [*left.columns, *right.columns]
    named = [df.select(*(F.col(n).alias(c) for n, c in zip(lefts + rights, columns, strict=True))) for df in out]
    if compared:
        named = [df.where((F.col(low_a) < F.col(high_b)) & (F.col(low_b) < F.col(high_a))) for df in named]
    return named[0].union(named[1])
