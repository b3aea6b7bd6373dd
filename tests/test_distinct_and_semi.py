"""Bitmaps that merge into exact distinct counts; semi-structured columns with malformed rows and mixed types."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import semi
from quarry.operators import distinct_bitmaps, distinct_counts, merged
from quarry.staging import stage


def test_counts_from_stored_bitmaps_are_exact(spark):
    """Ids of all signs over many buckets, one group with most rows, null ids and keys; a day added later."""
    rnd = random.Random(2)
    pool = [0, 1, -1, 32_767, 32_768, 32_769, -32_768, 2**40, 2**62, -(2**62), *(rnd.randrange(-(10**6), 10**6) for _ in range(300))]
    rows = [(rnd.choice(["a"] * 8 + ["b", None]), rnd.randrange(6), rnd.choice([*pool, None])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, day int, id long")
    old, new = (stage(distinct_bitmaps(df.where(c), ["k", "day"], "id")) for c in ("day < 4", "day >= 4"))
    stored = old.union(new)
    for by in (["k", "day"], ["k"], ["day"], [F.floor(F.col("day") / 3).alias("half")], []):
        got = sorted(map(tuple, distinct_counts(stored, by).collect()), key=repr)
        half = df.withColumn("half", F.floor(F.col("day") / 3))
        names = [b if isinstance(b, str) else "half" for b in by]
        want = half.where("id IS NOT NULL").groupBy(*names).agg(F.count_distinct("id"))
        assert got == sorted(map(tuple, want.collect()), key=repr)
    assert distinct_counts(merged(stored, ["k"]), []).first()[0] == df.select("id").distinct().where("id IS NOT NULL").count()
    assert distinct_counts(distinct_bitmaps(df.limit(0), ["k"], "id"), ["k"]).count() == 0


@pytest.fixture
def odd(spark):
    texts = ['{"a": 1}', '{"a": 2.5, "b": {"c": [1, "x", null]}}', '{"a": "7"}', '{"a": null}', "[1, 2]", "3", "", "{", None, '{"a": 1, "a": 2}', '{"ä": "日本"}', "null"]
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("v", semi.parsed("text"))


def test_paths_of_mixed_and_malformed_rows(odd):
    got = {r["id"]: r for r in odd.select("id", semi.at("v", "$.a", "long").alias("n"), semi.at("v", "$.b.c[1]", "string").alias("s"), semi.malformed("text", "v").alias("bad")).collect()}
    assert {k for k, r in got.items() if r["bad"]} >= {6, 7} and not got[8]["bad"] and not got[0]["bad"]
    assert (got[0]["n"], got[1]["n"], got[2]["n"], got[3]["n"], got[4]["n"]) == (1, 2, 7, None, None)
    assert got[1]["s"] == "x" and got[0]["s"] is None


def test_schema_holds_all_values(odd):
    said = semi.schema_of(odd.where("id IN (0, 1)"), "v").first()["schema"]
    assert said.startswith("OBJECT<a: DECIMAL") and "b: OBJECT<c: ARRAY<VARIANT>>" in said
    assert semi.schema_of(odd.where("id IN (0, 2)"), "v").first()["schema"] == "OBJECT<a: VARIANT>"


def test_entries_of_objects_and_arrays(odd):
    got = [(r["id"], r["pos"], r["key"]) for r in semi.entries(odd.where("id IN (1, 4, 5)").select("id", "v"), "v").orderBy("id", "pos").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (4, 0, None), (4, 1, None)]
