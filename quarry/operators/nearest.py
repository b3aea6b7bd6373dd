"""k nearest neighbours of every query row: an inverted file of cells, searched in blocks, and the exact answer by bounds on the cells.

Centres come from a bounded sample (SAMPLE rows by hash, LLOYD rounds of k-means in numpy); every row goes to its nearest centre's cell.
A query searches the ``probes`` cells with the nearest centres. With ``exact``, a second pass searches each further cell that could hold a nearer row: by the
triangle inequality none of its rows is nearer than the distance to its centre less the cell's radius. Only cells within the k-th distance found so far are left.

Queries and rows of a cell are dealt into chunks of CHUNK; a task meets one pair of chunks at a time and hands on k rows for each query, which are merged.
So no cell has to fit a task, however many rows it has.

Vectors that are null, hold a null or a non-finite component, or differ in length from the sample's first, take no part; nor do null ids as queries. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.staging import stage

SAMPLE, CELLS, LLOYD, CHUNK = 8192, 64, 8, 4096
#: Cells that a query searches. The test tables' vectors are nearly without clusters: 32 of 64 cells find 89 to 94 % of ten neighbours there, 40 find 95 to 97 %.
PROBES = 40


def whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (doubles) of the rows that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size("v") > 0))


def vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def centres(rows: DataFrame, cells: int = CELLS) -> np.ndarray:
    """k-means over the sample, which is the same for the same rows however they are partitioned."""
    found = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
    if not found:
        return np.zeros((0, 0))
    width = len(found[0]["v"])
    x = np.array([r["v"] for r in found if len(r["v"]) == width])
    out = np.unique(x, axis=0)
    out = out[np.linspace(0, len(out) - 1, min(cells, len(out))).astype(int)]
    for _ in range(LLOYD):
        near = distances(x, out).argmin(1)
        n = np.bincount(near, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, never below zero."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def placed(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """id, v, cell and the distance to its centre, of rows of the centres' width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                far = distances(vectors(part.column(1)), centre)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(cell)), cell]))], ["id", "v", "cell", "off"])

    return rows.where(F.size("v") == centre.shape[1]).mapInArrow(run, "id long, v array<double>, cell int, off double")


def probed(queries: DataFrame, centre: np.ndarray, probes: int) -> DataFrame:
    """id, v, cell, the distance to each centre, and its place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                far = distances(vectors(part.column(1)), centre)
                order = np.argsort(far, 1, kind="stable")[:, :probes]
                rows = np.repeat(np.arange(len(far)), order.shape[1])
                taken = [c.take(pa.array(rows)) for c in part.columns]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(order.ravel().astype(np.int32)), pa.array(np.sqrt(np.take_along_axis(far, order, 1)).ravel())], ["id", "v", "cell", "away"])

    return queries.where(F.size("v") == centre.shape[1]).mapInArrow(run, "id long, v array<double>, cell int, away double")


def searched(queries: DataFrame, rows: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """query_id, id and distance (squared): of each query the k nearest rows in each pair of chunks. queries: id, v, cell; sizes: chunks of each cell on both sides."""

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        if not q.num_rows or not r.num_rows:
            return none
        x, y, ids, own = vectors(r["v"].combine_chunks()), vectors(q["v"].combine_chunks()), r["id"].to_numpy(), q["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids, out = x[order], ids[order], []
        for at in range(0, len(y), 512):
            part, name = y[at : at + 512], own[at : at + 512]
            guess = distances(part, x)
            guess[name[:, None] == ids[None]] = np.inf  # not itself
            n = min(k, len(x))
            # Candidates by the quick formula with room for its rounding; then the plain sum of squares.
            edge = np.partition(guess, n - 1, 1)[:, n - 1 : n]
            i, j = np.nonzero((guess <= edge * (1 + 1e-9) + 1e-9 * (x**2).sum(1).max()) & np.isfinite(guess))
            far = ((part[i] - x[j]) ** 2).sum(1)
            by = np.lexsort((ids[j], far, i))
            i, j, far = i[by], j[by], far[by]
            start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
            keep = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) < k
            out.append(pa.table({"query_id": name[i[keep]], "id": ids[j[keep]], "distance": far[keep]}))
        return pa.concat_tables(out)

    keys = ["cell", "own_chunk", "row_chunk"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    q = queries.join(sizes, "cell").select("id", "v", "cell", dealt("nq").alias("own_chunk"), spread("nr").alias("row_chunk"))
    r = rows.join(sizes, "cell").select("id", "v", "cell", spread("nq").alias("own_chunk"), dealt("nr").alias("row_chunk"))
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, distance double")


def knn_join(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, probes: int = PROBES, exact: bool = True, cells: int = CELLS) -> DataFrame:
    """query_id, rank (from 1), id, distance (squared, Euclidean): the k rows nearest to each query, itself left out by its id. ids must be unique among queries.

    Without ``exact`` the answer is that of the nearest ``probes`` cells alone. Fitting the centres runs when this is called, as do the writes of the index.
    """
    kept = whole(rows, key, vector)
    centre = centres(kept, cells)
    if not len(centre):
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance double")
    index = stage(placed(kept, centre), "index")
    asked = stage(probed(whole(queries, key, vector), centre, len(centre)), "asked")
    own = Window.partitionBy("id").orderBy("away", "cell")
    near = asked.withColumn("place", F.row_number().over(own))
    radius = index.groupBy("cell").agg(F.max("off").alias("radius"), F.ceil(F.count("*") / CHUNK).cast("int").alias("nr"))

    def search(some: DataFrame) -> DataFrame:
        sizes = some.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("nq")).join(radius.select("cell", "nr"), "cell")
        return stage(searched(some.select("id", "v", "cell"), index, sizes, k), "found")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = search(near.where(F.col("place") <= probes))
    if exact and probes < len(centre):
        # The k-th distance so far; without so many rows, every cell is searched.
        last = best(found).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.sqrt(F.max("distance"))).alias("reach"))
        open_ = near.where(F.col("place") > probes).join(radius, "cell").join(last, "id", "left")
        could = F.col("reach").isNull() | ((F.col("away") - F.col("radius")) * (1 - 1e-9) - 1e-9 <= F.col("reach"))
        found = found.union(search(open_.where(could).select("id", "v", "cell")))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance")
