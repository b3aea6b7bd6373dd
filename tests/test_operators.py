from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from quarry import plans
from quarry.operators import asof_join, intervals, overlap_join, range_join, salted_distinct, sessions, top_k
from quarry.sources import FORMATS, read, table, write


def test_asof_ties_nulls_and_clashing_names(spark):
    at = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, "a", at), (2, "a", at + timedelta(hours=1)), (3, None, at), (4, "b", None), (5, "a", at - timedelta(days=1))], "id long, k string, at timestamp_ntz")
    right = spark.createDataFrame([(10, "a", at), (11, "a", at), (12, None, at), (13, "b", None), (14, "a", at + timedelta(minutes=59))], "id long, k string, at timestamp_ntz")
    right = right.withColumnRenamed("id", "r_id")
    got = asof_join(left, right, ["k"], "at", "at", ["r_id"], "r_id")
    assert {r["id"]: r["r_id"] for r in got.collect()} == {1: 11, 2: 14, 3: None, 4: None, 5: None}
    assert asof_join(left, right.limit(0), ["k"], "at", "at", ["r_id"], "r_id").where("r_id IS NOT NULL").count() == 0


def test_range_join_against_brute_force(spark):
    points = spark.createDataFrame([(k, float(k) / 3 - 20) for k in range(120)] + [(999, None)], "p long, at double")
    spans = spark.createDataFrame([(k, float(k) - 10, float(k) - 10 + k % 7) for k in range(30)] + [(99, None, 3.0)], "s long, lo double, hi double")
    got = sorted((r["p"], r["s"]) for r in range_join(points, spans, "at", "lo", "hi", 3).collect())
    want = sorted((p["p"], s["s"]) for p in points.collect() for s in spans.collect() if None not in (p["at"], s["lo"]) and s["lo"] <= p["at"] < s["hi"])
    assert got == want
    with pytest.raises(ValueError):
        range_join(points, spans, "at", "lo", "hi", 0)
    wide = spark.createDataFrame([(1, 0.0, 1e12), (2, -5.0, 1.0), (3, 3.0, 5000.0)], "s long, lo double, hi double")
    got = sorted((r["p"], r["s"]) for r in range_join(points, wide, "at", "lo", "hi", 1).collect())
    assert got == sorted((p["p"], s["s"]) for p in points.collect() for s in wide.collect() if p["at"] is not None and s["lo"] <= p["at"] < s["hi"])


@pytest.mark.parametrize("chunk", [3, 20_000])
def test_overlap_join_against_brute_force(spark, chunk):
    """Lengths over five orders of magnitude, hot buckets, equal rows, empty and null intervals; each pair once."""
    rnd = random.Random(4)

    def spans(n, seed):
        r = random.Random(seed)
        out = [(k, x := r.choice([0.0, 1.0, r.uniform(-50, 500)]), x + r.choice([0.0, 0.5, 2.0, 2.0, 3.0, 40.0, 3000.0, 1e5])) for k in range(n)]
        return [*out, (n, None, 1.0), (n + 1, 1.0, None), (n + 2, 5.0, 4.0)]

    a, b = spans(80, rnd.random()), spans(90, rnd.random())
    left, right = spark.createDataFrame(a, "i long, af double, at double"), spark.createDataFrame(b, "j long, bf double, bt double")
    got = sorted((r["i"], r["j"]) for r in overlap_join(left, right, ("af", "at"), ("bf", "bt"), 2, chunk).collect())
    want = sorted((i, j) for i, s, e in a for j, x, y in b if None not in (s, e, x, y) and s < e and x < y and s < y and x < e)
    assert got == want and len(want) > 500
    assert overlap_join(left.limit(0), right, ("af", "at"), ("bf", "bt"), 2).count() == 0
    with pytest.raises(ValueError):
        overlap_join(left, right, ("af", "at"), ("bf", "bt"), 0)


def test_overlaps_compared_alone_against_brute_force(spark):
    """Empty and turned intervals by the two comparisons of SQL."""
    rnd = random.Random(8)
    spans = lambda n: [*((k, x := rnd.choice([0.0, 1.0, rnd.uniform(-50, 500)]), x + rnd.choice([0.0, 0.0, -1.0, -60.0, 2.0, 40.0, 3000.0])) for k in range(n)), (n, None, 1.0), (n + 1, 1.0, None)]
    a, b = spans(80), spans(90)
    left, right = spark.createDataFrame(a, "i long, af double, at double"), spark.createDataFrame(b, "j long, bf double, bt double")
    got = sorted((r["i"], r["j"]) for r in overlap_join(left, right, ("af", "at"), ("bf", "bt"), 2, compared=True).collect())
    want = sorted((i, j) for i, s, e in a for j, x, y in b if None not in (s, e, x, y) and s < y and x < e)
    assert got == want and any(x >= y for i, j in got for _, x, y in b[j : j + 1])


def test_overlaps_of_an_error_without_length(spark, tmp_path):
    """Errors worth under a minute's part last no second; the query's SQL counts them inside a purchase's 40 minutes."""
    at = datetime(2024, 1, 1)
    rows = [(1, at, 1, "purchase", 5.0, "{}"), (2, at + timedelta(minutes=9), 1, "error", 0.01, "{}"), (3, at, 1, "error", 0.01, "{}"), (4, at + timedelta(minutes=50), 2, "error", 0.0, "{}"), (5, at + timedelta(minutes=20), 2, "error", -0.5, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert_same(spark, plans.overlaps(spark, str(tmp_path)), plans.SQL["overlaps"], connect(str(tmp_path)))
    assert plans.overlaps(spark, str(tmp_path)).count() == 2


def test_overlaps_are_dealt_by_pairs(spark, monkeypatch):
    """Few rows of one bucket with many pairs: no task makes most of them."""
    monkeypatch.setattr(intervals, "RUN", 64, raising=False)
    monkeypatch.setattr(intervals, "PAIRS", 20_000, raising=False)
    left = spark.range(800).selectExpr("id AS i", "double(id % 7) AS af", "double(id % 7) + 5 AS at")
    right = spark.range(900).selectExpr("id AS j", "double(id % 5) AS bf", "double(id % 5) + 6 AS bt")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as tables of any size don't fit
    try:
        out = overlap_join(left, right, ("af", "at"), ("bf", "bt"), 100)
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = left.crossJoin(right).where("af < bt AND bf < at")
    assert sum(tasks) == want.count() and max(tasks) < sum(tasks) / 4
    assert out.exceptAll(want).count() == 0


def test_overlaps_without_bounds(spark):
    """Infinite bounds, NaN, which is above all numbers, and zeros of both signs."""
    inf, nan = float("inf"), float("nan")
    spans = [(k, x, y) for k, (x, y) in enumerate((x, y) for x in (-inf, -1.0, -0.0, 0.0, 2.0, inf, nan) for y in (-inf, -0.0, 0.0, 3.0, inf, nan))]
    left, right = spark.createDataFrame(spans, "i long, af double, at double"), spark.createDataFrame(spans, "j long, bf double, bt double")
    pairs = left.crossJoin(right).where("af < bt AND bf < at")
    got = [sorted((r["i"], r["j"]) for r in df.collect()) for df in (overlap_join(left, right, ("af", "at"), ("bf", "bt"), 2, compared=True), overlap_join(left, right, ("af", "at"), ("bf", "bt"), 2))]
    assert got == [sorted((r["i"], r["j"]) for r in df.collect()) for df in (pairs, pairs.where("af < at AND bf < bt"))]


def test_no_job_runs_while_a_range_join_is_built(spark):
    points, spans = spark.range(10).selectExpr("id AS p", "double(id) AS at"), spark.range(10).selectExpr("id AS s", "double(id) AS lo", "double(id + 2) AS hi")
    spark.sparkContext.setJobGroup("building", "")
    out = range_join(points, spans, "at", "lo", "hi", 2)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    assert out.count() == 19


def test_hot_buckets_are_dealt(spark):
    """All points in one bucket of all spans: each task of the join gets pairs of chunks."""
    points = spark.range(4000).selectExpr("id AS p", "double(id % 7) / 7 AS at")
    spans = spark.range(300).selectExpr("id AS s", "-double(id % 5) AS lo", "double(id % 3) + 0.1 AS hi")
    want = points.crossJoin(spans).where("at >= lo AND at < hi").count()
    out = range_join(points, spans, "at", "lo", "hi", 100, chunk=100)
    assert out.count() == want
    assert out.groupBy("p", "s").count().where("count > 1").count() == 0


def test_top_k_sessions_and_salted_distinct(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", at + timedelta(minutes=m), m % 3) for m in (0, 10, 50, 55, 200)], "k string, at timestamp_ntz, v int")
    assert sorted(r["n"] for r in sessions(df, "k", "at", "30 minutes").collect()) == [1, 2, 2]
    assert [r["rank"] for r in top_k(df, ["k"], [F.col("at").desc()], 2).collect()] == [1, 2]
    assert salted_distinct(df, ["k"], F.col("v")).first().asDict() == {"k": "a", "n_distinct": 3, "n": 5}
    assert salted_distinct(df.limit(0), ["k"], F.col("v")).count() == 0


@pytest.mark.parametrize("form", FORMATS)
def test_round_trip(spark, data, tmp_path, form):
    df = table(spark, data, "customer")
    write(df, str(tmp_path / form), form)
    back = read(spark, str(tmp_path / form), df.schema, form)
    assert df.exceptAll(back).count() == 0 and back.count() == df.count()


def test_filter_and_columns_reach_the_scan(spark, data):
    plan = table(spark, data, "lineitem").where("l_quantity > 40").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
