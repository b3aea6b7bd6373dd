"""Segmented scans and selection against brute force, and how a hot key's rows are dealt over tasks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import asof_join, counts_within, ntile, percentiles, positions, scan, selection, sessions
from quarry.operators.scan import sliced

START = datetime(2024, 1, 1)


def history(n, seed, users=4, minutes=400):
    """Rows of few keys, most of one; many at one time, some without key or time."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        key = rnd.choice(["a"] * 9 + ["b", "c", None])
        at = START + timedelta(minutes=rnd.randrange(minutes)) if rnd.random() > 0.03 else None
        rows.append((k, key, at))
    return rows


SCHEMA = "id long, k string, at timestamp_ntz"


@pytest.mark.parametrize("slices", [2, 16, 1024])
def test_asof_against_brute_force(spark, slices):
    left, right = history(300, 1), [(k + 1000, u, t) for k, u, t in history(120, 2)]
    a = spark.createDataFrame(left, SCHEMA)
    b = spark.createDataFrame(right, "r_id long, k string, at timestamp_ntz")
    got = {r["id"]: r["r_id"] for r in asof_join(a, b, ["k"], "at", "at", ["r_id"], "r_id", slices).collect()}
    want = {}
    for i, u, t in left:
        fits = [(x, j) for j, v, x in right if v == u and None not in (u, t, x) and x <= t]
        want[i] = max(fits)[1] if fits else None
    assert got == want


@pytest.mark.parametrize("slices", [2, 64])
def test_sessions_against_brute_force(spark, slices):
    rows = history(120, 3, minutes=3000)
    got = sorted((tuple(r) for r in sessions(spark.createDataFrame(rows, SCHEMA), "k", "at", "30 minutes", slices).collect()), key=repr)
    want = []
    for key in {u for _, u, _ in rows}:
        times = sorted(t for _, u, t in rows if u == key and t)
        run = []
        for t in times:
            if run and t - run[-1] >= timedelta(minutes=30):
                want.append((key, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        if run:
            want.append((key, run[0], run[-1], len(run)))
    assert got == sorted(want, key=repr) and len(want) > 20


@pytest.mark.parametrize("slices", [2, 64])
def test_positions_and_counts_against_brute_force(spark, slices):
    rows = history(250, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    x = positions(counts_within(df, "k", "at", "1 hour", "within", slices), "k", "at", "id", "id", slices).withColumn("quarter", ntile(4))
    got = {r["id"]: r for r in x.collect()}
    assert len(got) == len(rows)
    for key in {u for _, u, _ in rows}:
        own = sorted((t is not None, t or START, i) for i, u, t in rows if u == key)
        n = len(own)
        for place, (timed, t, i) in enumerate(own):
            r = got[i]
            assert (r["row"], r["total"], r["before"]) == (place + 1, n, own[place - 1][2] if place else None)
            assert r["rank"] == 1 + sum(o[:2] < (timed, t) for o in own)
            size, more = divmod(n, 4)
            assert r["quarter"] == 1 + next(q for q in range(4) if place < (q + 1) * size + min(q + 1, more))
            want = sum(o[0] and t - timedelta(hours=1) <= o[1] <= t for o in own) if timed and key else None
            assert r["within"] == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sessions(df, "k", "at", "1 hour").count() == 0
    assert positions(df, "k", "at", "id", "id").count() == 0
    assert counts_within(df, "k", "at", "1 hour", "n").count() == 0
    assert asof_join(df, df.withColumnRenamed("id", "r"), ["k"], "at", "at", ["r"], "r").count() == 0
    with pytest.raises(ValueError):
        sliced(df, "at", 3)
    with pytest.raises(ValueError):
        positions(df.withColumn("row", F.lit(1)), "k", "at", "id", "id")


def test_a_hot_key_is_dealt_over_tasks(spark):
    """Of 20,000 rows 90 % are one key's; shuffled as the scans shuffle them, no task has a tenth."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("at"))
    dealt = sliced(df, "at", 256).repartition(40, "k", "slice").groupBy(F.spark_partition_id()).count()
    counts = [r["count"] for r in dealt.collect()]
    assert sum(counts) == 20_000 and max(counts) < 2_000
    for out in (sessions(df, "k", "at", "2 minutes"), positions(df, "k", "at", "id", "id"), asof_join(df, df.withColumnRenamed("id", "r"), ["k"], "at", "at", ["r"], "r")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and "slice" in plan
    assert sessions(df, "k", "at", "2 minutes", 64).where("k = -1").count() == 2000  # each tenth minute is another key's
    assert positions(df, "k", "at", "id", "id", 64).where("k = -1").agg(F.max("row")).first()[0] == 18_000


@pytest.mark.parametrize("few", [1, 4096])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.77, 1.0])
def test_percentiles_against_numpy(spark, few, q):
    rnd = np.random.default_rng(6)
    groups = {"normal": rnd.normal(size=3000), "skewed": np.exp(rnd.normal(size=700) * 40), "ties": rnd.integers(0, 3, 800).astype(float), "one": np.array([4.5]), "same": np.full(400, 2.0), None: rnd.normal(size=301)}
    rows = [(k, float(x), "clash") for k, v in groups.items() for x in v] + [("empty", None, "x"), ("one", None, "x")]
    got = {r["k"]: r["percentile"] for r in percentiles(spark.createDataFrame(rows, "k string, x double, v string"), ["k"], "x", q, few).collect()}
    assert set(got) == {*groups, "empty"} and got["empty"] is None
    for k, v in groups.items():
        assert got[k] == pytest.approx(float(np.quantile(v, q)), rel=1e-12)


def test_percentiles_take_rounds_not_tasks(spark, monkeypatch):
    """A group of 100,000 values is narrowed to few before any are ranked."""
    seen = []
    stage = selection.stage
    monkeypatch.setattr(selection, "stage", lambda df, name="stage": seen.append(name) or stage(df, name))
    df = spark.range(100_000).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % 100_003).alias("x"))
    want = sorted((k * 7919) % 100_003 for k in range(100_000))
    got = percentiles(df, ["k"], "x", 0.25, few=8).first()["percentile"]
    assert got == pytest.approx(want[24_999] + 0.75 * (want[25_000] - want[24_999]))
    assert 1 <= seen.count("pivots") <= 4
    with pytest.raises(ValueError):
        percentiles(df, ["k"], "x", 1.5)
    assert percentiles(df.limit(0), ["k"], "x", 0.5).count() == 0


@pytest.mark.parametrize("few", [0, 40])
def test_large_keys_carry_over_slices(spark, monkeypatch, few):
    """The brute force above with keys that count as large: all, or some of them."""
    monkeypatch.setattr(scan, "FEW", few)
    test_asof_against_brute_force(spark, 16)
    test_sessions_against_brute_force(spark, 64)
    test_positions_and_counts_against_brute_force(spark, 64)


def test_usual_keys_are_not_sliced(spark, monkeypatch):
    """Keys of few rows make one summary each, however many slices time has; only the large key is cut."""
    rows = [(k, "a" if k < 500 else None if k % 50 == 0 else f"u{k % 50}", START + timedelta(minutes=k % 500)) for k in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sliced(df, "at", 256, by=["k"]).select("slice").distinct().collect() == [(0,)]
    monkeypatch.setattr(scan, "FEW", 100)
    got = {r["k"]: r["n"] for r in sliced(df, "at", 256, by=["k"]).groupBy("k").agg(F.count_distinct("slice").alias("n")).collect()}
    assert got.pop("a") > 100 and set(got.values()) == {1} and len(got) == 50
