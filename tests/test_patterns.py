"""Row patterns against brute force, with hot keys, ties, and matches over the edges of slices."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest

from quarry.functions.patterns import Step, advance, match, matcher

START = datetime(2024, 1, 1)
STEPS = [Step("seen", ("view",)), Step("tried", ("click", "error"), many=True), Step("bought", ("purchase",))]


def brute(rows, steps, within):
    """By regular expressions over the rows after each start."""
    form = re.compile("".join(f"(?:{'|'.join(s.kinds)})" .replace("view", "v").replace("click", "c").replace("error", "e").replace("purchase", "p") + ("+?" if s.many else "") for s in steps))
    out = []
    for key in {r[1] for r in rows if r[1] is not None}:
        own = sorted((t, i, k) for i, u, t, k in rows if u == key and t is not None)
        text = "".join((k or "x")[0] for _, _, k in own)
        for at in range(len(own)):
            m = form.match(text, at)
            if m and own[m.end() - 1][0] - own[at][0] <= within:
                out.append((key, own[at][1], own[m.end() - 1][1], m.end() - at))
    return sorted(out)


@pytest.mark.parametrize("slice_seconds", [None, 7200])
def test_matches_against_brute_force(spark, slice_seconds):
    rnd = random.Random(5)
    rows = [(k, rnd.choice(["a"] * 6 + ["b", None]), START + timedelta(minutes=rnd.randrange(3000)) if rnd.random() > 0.02 else None, rnd.choice(["view", "click", "click", "error", "purchase", "signup", None])) for k in range(2400)]
    df = spark.createDataFrame(rows, "id long, k string, at timestamp_ntz, kind string")
    got = sorted(map(tuple, match(df, STEPS, "k", "at", "id", "kind", 1800, slice_seconds).collect()))
    want = brute(rows, STEPS, timedelta(minutes=30))
    assert got == want and len(want) > 10
    twice = [Step("one", ("view", "click"), many=True), Step("two", ("click", "purchase"))]  # a row may go either way
    got = sorted(map(tuple, match(df, twice, "k", "at", "id", "kind", 3600).collect()))
    assert got == brute(rows, twice, timedelta(hours=1)) and got


def test_steps_and_odd_input(spark):
    assert advance(STEPS, -1, "view") == {0} and advance(STEPS, 1, "click") == {1} and advance(STEPS, 1, "purchase") == {2} and advance(STEPS, 0, "purchase") == set()
    df = spark.createDataFrame([], "id long, k string, at timestamp_ntz, kind string")
    assert match(df, STEPS, "k", "at", "id", "kind", 60).count() == 0
    with pytest.raises(ValueError):
        match(df, [], "k", "at", "id", "kind", 60)


@pytest.mark.parametrize("size", [1, 3, 50, 5000])
def test_batches_cut_anywhere(size):
    """The scan itself on Arrow batches of any size, as sorted rows come: open starts go on in the next batch, and not in the next group. Ids may be null."""
    import pyarrow as pa

    rnd = random.Random(9)
    rows = sorted((rnd.choice("aab"), 0, rnd.randrange(10**6), k, rnd.choice(["view", "click", "click", "error", "purchase", "x"])) for k in range(1500))
    rows = [(k, s, t, None if i == rows[700][3] else i, kind) for k, s, t, i, kind in rows]
    fresh = [rnd.random() < 0.8 for _ in rows]
    columns = [pa.array([r[c] for r in rows]) for c in range(5)] + [pa.array(fresh)]
    whole = pa.RecordBatch.from_arrays(columns, ["k", "slice", "at", "id", "kind", "fresh"])
    got = [tuple(r.values()) for b in matcher(STEPS, 3000)(whole.slice(k, size) for k in range(0, len(rows), size)) for r in b.to_pylist()]
    want = []
    for a in range(len(rows)):
        states = {-1} if fresh[a] else set()
        for b in range(a, len(rows)):
            states = set().union(*(advance(STEPS, s, rows[b][4]) for s in states)) if rows[b][0] == rows[a][0] and rows[b][2] - rows[a][2] <= 3000 else set()
            if not states or 2 in states:
                break
        if 2 in states:
            want.append((rows[a][0], rows[a][3], rows[b][3], b - a + 1))
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 15


def test_no_call_of_python_for_each_row(spark):
    """Rows go to Python as batches of many keys, not one by one and key by key."""
    plan = match(spark.range(10).selectExpr("id", "id AS k", "timestamp_ntz '2024-01-01' AS at", "'view' AS kind"), STEPS, "k", "at", "id", "kind", 60)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "UDTF" not in plan
