"""The k-nearest join against brute force: exact with ties and hot cells, and the recall of the cells alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import knn_join, nearest
from quarry.sources import table


def brute(x, ids, asked, k):
    out = []
    for q in asked:
        at = ids.index(q)
        far = sorted((float(((x[at] - v) ** 2).sum()), j) for v, j in zip(x, ids, strict=True) if j != q)
        out += [(q, r, j, d) for r, (d, j) in enumerate(far[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [7, 4096])
def test_exact_with_ties_copies_and_small_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(nearest, "CHUNK", chunk)
    rnd = np.random.default_rng(1)
    x = np.r_[np.tile([1.0, 2.0, 3.0], (60, 1)), rnd.integers(-4, 5, (140, 3)).astype(float)]
    ids = [int(i) for i in rnd.permutation(200)]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, x)] + [(900, None, "x"), (901, [1.0, float("nan"), 0.0], "x"), (902, [1.0], "x"), (903, [], "x"), (None, [0.0, 0.0, 0.0], "x"), (904, [1.0, None, 2.0], "x")], "key long, e array<double>, id string")
    got = sorted(map(tuple, knn_join(df.where("key % 10 = 0"), df, "key", "e", 5, probes=1, cells=9).collect()))
    assert got == brute(x, ids, [i for i in ids if i % 10 == 0], 5)


def test_fewer_rows_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "key long, e array<float>")
    assert sorted(map(tuple, knn_join(df, df, "key", "e", 5, probes=1).collect())) == [(0, 1, 1, 1.0), (0, 2, 2, 9.0), (1, 1, 0, 1.0), (1, 2, 2, 4.0), (2, 1, 1, 4.0), (2, 2, 0, 9.0)]
    assert knn_join(df.limit(0), df, "key", "e", 2).count() == 0
    assert knn_join(df, df.limit(0), "key", "e", 2).count() == 0


def test_recall_of_the_cells_alone(spark, data):
    """The index without the second pass finds nine of ten neighbours or more."""
    df = table(spark, data, "embeddings")
    asked = df.where("vec_id % 20 = 0")
    true = {(r["query_id"], r["id"]) for r in knn_join(asked, df, "vec_id", "embedding", 10).collect()}
    got = {(r["query_id"], r["id"]) for r in knn_join(asked, df, "vec_id", "embedding", 10, exact=False).collect()}
    rows = df.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), [r["vec_id"] for r in rows]
    assert true == {(q, j) for q, _, j, _ in brute(x, ids, [i for i in ids if i % 20 == 0], 10)}
    assert len(true & got) >= 0.9 * len(true)
    assert df.where(F.col("vec_id") % 20 == 0).count() * 10 == len(true)
