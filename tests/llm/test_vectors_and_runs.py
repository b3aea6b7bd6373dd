"""Exact search and code compression against brute force and SQL; periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from compare import assert_same, connect
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.llm import codes, runs, topk
from quarry.llm.common import Workspace, table

VECTORS = "vec_id long, embedding array<float>, label int, v string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], VECTORS)


def floors(x, factor):
    return [int(np.floor(factor * float(np.float32(c)))) for c in x]


def usable(x):
    return x is not None and all(c is not None and np.isfinite(c) for c in x)


# --- search ---------------------------------------------------------------------------------------------------


def brute_search(rows, k=20, every=20):
    kept = [(i, floors(x, 64)) for i, x, _ in rows if usable(x)]
    out = []
    for at, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(q, c)), j is None, j or 0) for b_, (j, c) in enumerate(kept) if b_ != at]
        out += [(i, r, None if unnamed else j, -s) for r, (s, unnamed, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, rows, **more):
    got = topk.search(spark, frame(spark, rows), **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_search_is_sql(spark, data):
    assert_same(spark, topk.search(spark, table(spark, data, "embeddings")), topk.sql(), connect(data))


def test_search_with_ties_copies_and_many_blocks(spark, monkeypatch):
    """A third of all rows are one vector, many scores are equal; several blocks of each kind and ranges."""
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "RANGE", 2)
    rnd = np.random.default_rng(5)
    rows = [(k, [0.5, -0.25, 0.125, 1.0, 0.5], 0) if k % 3 == 0 else (k, (rnd.integers(-3, 4, 5) / 64).tolist(), 1) for k in range(240)]
    assert searched(spark, rows) == brute_search(rows)
    assert searched(spark, rows, k=3, every=7) == brute_search(rows, 3, 7)


def test_search_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [2.0, 1.0], 1), (20, [], 1), (40, None, 1), (60, [1.0, None], 1), (80, [inf, 1.0], 1), (100, [nan], 1), (None, [1.0, 2.0], 1), (None, [5.0], 1), (7, [1.0, 2.0, 0.0], 1), (8, [1.0], 1), (-20, [-1.0, -1.0, -1.0], 1), (9, [3e5, 1.0], 1), (11, [1.0, 2.0], None)]
    assert searched(spark, rows) == brute_search(rows)
    assert searched(spark, rows, k=2) == brute_search(rows, 2)


def test_search_leaves_out_integers_that_do_not_fit(spark):
    rows = [(0, [1.0], 1), (1, [1e30], 1), (2, [2.0], 1)]
    assert [r[2] for r in searched(spark, rows)] == [2]


def test_search_of_nothing(spark):
    for rows in ([], [(1, [1.0], 1)], [(0, None, 1)]):
        assert searched(spark, rows) == []
    assert searched(spark, [(0, [1.0], 1)]) == []  # no other row


def test_only_entries_over_the_cutoff_leave_their_lists(spark, data):
    df = table(spark, data, "embeddings").select("vec_id", "embedding")
    s = topk.Search(Workspace(spark, "test"), topk.quantised(df, 64, "embedding", "vec_id", strip=True), 20, 20)
    gathered = s.gathered().persist()
    over = s.over(s.cutoffs(gathered, s.answers(gathered)))
    n = over.select(F.sum(F.octet_length("q") / 2)).first()[0]
    assert 0 < n < 0.6 * topk.PARTS * s.n * s.n_queries
    gathered.unpersist()


# --- codes ----------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, floors(x, 4096), label) for i, x, label in rows if usable(x)]
    width = -(-max((len(x) for _, x, _ in kept), default=0) // parts)
    kept = [(i, x + [0] * (parts * width - len(x)), label) for i, x, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:entries]
    books = [[x[p * width : (p + 1) * width] for _, x, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for k in range(rounds + 1):
        near = [[min(range(len(books[p])), key=lambda e: (far(x[p * width : (p + 1) * width], books[p][e]), e)) for p in range(parts)] for _, x, _ in kept]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [x[p * width : (p + 1) * width] for (_, x, _), c in zip(kept, near) if c[p] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(far(x[p * width : (p + 1) * width], books[p][c[p]]) for p in range(parts)) for (_, x, _), c in zip(kept, near)]
    by = {}
    for (_, _, label), e in zip(kept, errors):
        by[label] = by.get(label, 0) + e
    return sorted(((i, "".join(f"{c:02x}" for c in near[k]), errors[k], by[label], digest) for k, (i, _, label) in enumerate(kept)), key=repr)


def coded(spark, rows):
    got = codes.report(spark, frame(spark, rows))
    return sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_are_sql(spark, data):
    assert_same(spark, codes.report(spark, table(spark, data, "embeddings")), codes.sql(), connect(data))


def test_codes_with_ties_against_brute_force(spark):
    """Few different components, so that distances tie and entries coincide and stay unused."""
    rnd = np.random.default_rng(3)
    rows = [(int(k), (rnd.integers(-2, 3, 16) / 4096).tolist(), [None, 1, 2][k % 3]) for k in rnd.permutation(150)]
    assert coded(spark, rows) == brute_codes(rows)
    rows = [(k, [0.5] * 8 if k % 3 else (rnd.integers(-400, 400, 8) / 4096).tolist(), 1) for k in range(90)]
    assert coded(spark, rows) == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    rows = [(3, [1.0, -0.3], 1), (3, [0.2, 0.1], 1), (None, [0.4] * 9, None), (1, [], None), (5, None, 1), (6, [1.0, None], 1), (7, [float("nan")], 2), (8, [float("-inf")], 2), (3, [1.0, -0.3], 1), (2, [-1e-9], 2)]
    assert coded(spark, rows) == brute_codes(rows)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    assert coded(spark, [(1, [1e30], 1), (2, [1.0], 1)]) == coded(spark, [(2, [1.0], 1)])
    assert [r[1:3] for r in coded(spark, [(4, [], 1)])] == [("00" * 8, 0)]


def test_bounds_spare_scans_and_hold(spark, data):
    """Bounds are those of the exact distances, and the last round scans a part of what the first does."""
    work = Workspace(spark, "test")
    state, book = codes.compress(work, table(spark, data, "embeddings"))
    rows = state.collect()
    for r in rows[:100]:
        x = np.frombuffer(r["v"], "<i4").reshape(8, -1).astype(np.int64)
        for p in range(8):
            far = np.sqrt(((book[p] - x[p]) ** 2).sum(1))
            code = r["code"][p]
            assert np.frombuffer(r["upper"], "<f8")[p] >= far[code] * (1 - 1e-12)
            assert np.frombuffer(r["lower"], "<f8")[p] <= np.delete(far, code).min() * (1 + 1e-12)
    assert 0 < sum(r["scanned"] for r in rows) < 0.7 * 8 * len(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_assignments_follow_moving_entries(seed):
    rnd = np.random.default_rng(seed)
    x, entries = rnd.integers(-6, 7, (80, 2)), rnd.integers(-6, 7, (1, int(rnd.integers(1, 6)), 2))
    books = codes.Codebooks.of(entries)
    code, upper, lower = np.zeros(80, np.uint8), np.full(80, np.inf), np.zeros(80)
    for _ in range(5):
        codes.assign(x, books, code, upper, lower, 0)
        assert (code == ((x[:, None] - books.entries[0]) ** 2).sum(2).argmin(1)).all()
        moved = books.entries + rnd.integers(-1, 2, entries.shape)
        books = codes.Codebooks.of(moved, books.entries)


# --- runs -----------------------------------------------------------------------------------------------------


def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            s = i
            while i < n - p and w[i] == w[i + p]:
                i += 1
            if i > s:
                part = w[s : i + p]
                if len(part) >= max(6, 4 * p) and not any(all(a == b for a, b in zip(part, part[q:])) for q in range(1, p)):
                    out.append((s, len(part), p))
            else:
                i += 1
    return sorted(out)


def test_runs_against_brute_force():
    rnd = random.Random(1)
    for _ in range(1500):
        k, n, w = rnd.choice([1, 2, 2, 3, 5]), rnd.choice([0, 1, 5, 6, 7, 8, 20, 40, 90, 200, 330]), []
        while len(w) < n:
            block = [rnd.randrange(k) for _ in range(rnd.randrange(1, 9))]
            w += block * rnd.choice([1, 1, rnd.randrange(1, 9)])
        assert runs.find_runs(np.array(w[:n], np.int32)) == brute_runs(w[:n])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=30), st.integers(1, 6)), max_size=8))
def test_runs_of_nested_repetitions(blocks):
    w = [c for block, n in blocks for c in block * n]
    assert runs.find_runs(np.array(w, np.int32)) == brute_runs(w)


def test_long_periods_and_long_texts():
    rnd = np.random.default_rng(2)
    block = rnd.integers(0, 1000, 5000)
    w = np.r_[rnd.integers(0, 1000, 777), np.tile(block, 6)[:27_123], rnd.integers(1000, 2000, 500)].astype(np.int32)
    found = runs.find_runs(w)
    assert (777, 27_123, 5000) in [(s + 777 - s, n - (777 - s), p) for s, n, p in found if p == 5000]
    assert runs.find_runs(np.zeros(1_000_000, np.int32)) == [(0, 1_000_000, 1)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, k, p in found for i in range(s + p, s + k)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    told = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    said = "".join(f"{s},{k},{p}\n" for s, k, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(found), *told, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_report_against_brute_force(spark):
    base = ["", None, " \t\n", "one", "a a a a a a", "a b a b a b a b", "x " * 500, "a b " * 7, "a\x0bb\x0cc " * 5, "der die das und " * 9 + "Ende", " ".join(f"w{k * k % 17}" for k in range(120))]
    rows = [(k if k % 13 else None, base[k % len(base)]) for k in range(150)] + [(14, "same row " * 4)] * 2
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, start int, n_runs string")
    got = sorted((tuple(r)[:8] for r in runs.report(df).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 20
    assert runs.report(df.limit(0)).count() == 0


def test_report_of_the_table(spark, data):
    df = table(spark, data, "documents")
    some = df.where(F.length("text") < 3000)
    want = sorted((expected(r["doc_id"], r["text"]) for r in some.collect()), key=repr)
    assert sorted((tuple(r)[:8] for r in runs.report(some).collect()), key=repr) == want
    assert runs.report(df).count() == df.count()


def test_spans_and_collapsed(spark):
    df = spark.createDataFrame([(1, "to be or not to be or not to be or not to be or not yes"), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in runs.spans(df).collect()] == [(1, 0, 16, 4)]
    assert [tuple(r) for r in runs.collapsed(df).collect()] == [(1, "to be or not yes"), (None, "")]
    assert pytest.approx(0) == runs.collapsed(df.limit(0)).count()
