"""Vector code compression: product quantisation whose codebooks come from Hamerly's bounds on Lloyd's rounds, all in integers.

Vectors of integers (floor(4096 x)) are cut into PARTS equal parts; each part has a codebook of up to ENTRIES entries, which starts as that
part of the first vectors by id. A round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index) and
replaces each entry by the floor of its parts' mean; unused entries stay.

Each part of a vector keeps its entry, an upper bound of the distance to it, and a lower bound of that to the second nearest. When entries move, the upper bound
grows by what its own entry moved, the lower one shrinks by the most that another did. While the upper bound is strictly below the lower one,
or strictly below half the distance from its entry to the nearest other, the entry is still the only nearest one and nothing is computed.
Else the upper bound becomes the exact distance; only where that doesn't settle it either are all distances computed, in integers. Bounds are
rounded outwards, so a tie never counts as settled, and the lower index wins it in the full scan.

The state is a table in the shared folder, written anew each round with the vectors, so a lost executor costs its tasks of that round. What
reaches the driver are sums and counts of the entries: PARTS * ENTRIES numbers for each component, summed by Spark first.

Rows: vectors that are null or hold null or non-finite components take no part, nor do those with an integer beyond ``vectors.LARGEST``,
whose sums don't fit 64 bits. Shorter vectors count as ending in zeros, and the width is that of the longest, rounded up to a multiple of PARTS. Null ids
come last for the first entries; rows of one id by their integers. Fewer vectors than ENTRIES make smaller codebooks. Null
labels are one label. Repeated rows are rows. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.common import Workspace, attach
from quarry.llm.vectors import matrix, quantised

FACTOR, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that a task computes at once.
AT_ONCE = 4096
#: Relative and absolute slack of a bound: far above the rounding of a few additions in doubles.
SLACK = 1e-9


@dataclass(frozen=True)
class Codebooks:
    """entries: part, entry, position. moved: how far each entry moved since the bounds were made; near: half the distance to its nearest other."""

    entries: np.ndarray
    moved: np.ndarray
    near: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, before: np.ndarray | None = None) -> Codebooks:
        moved = np.zeros(entries.shape[:2]) if before is None else np.sqrt(((entries - before) ** 2).sum(2))
        apart = ((entries[:, :, None] - entries[:, None]) ** 2).sum(3).astype(np.float64)
        apart[:, np.arange(entries.shape[1]), np.arange(entries.shape[1])] = np.inf
        return Codebooks(entries, moved * (1 + SLACK) + SLACK * (moved > 0), np.sqrt(apart.min(2)) / 2 * (1 - SLACK) - SLACK)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For parts x: the nearest entry (ties to the lower index), its distance rounded up, and that of the second nearest rounded down."""
    far = np.stack([((x - e) ** 2).sum(1) for e in entries], 1)
    code = far.argmin(1)
    rows = np.arange(len(x))
    upper = np.sqrt(far[rows, code].astype(np.float64)) * (1 + SLACK)
    if len(entries) == 1:
        return code, upper, np.full(len(x), np.inf)
    far[rows, code] = np.iinfo(np.int64).max
    return code, upper, np.sqrt(far.min(1).astype(np.float64)) * (1 - SLACK)


def assign(x: np.ndarray, books: Codebooks, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, part: int) -> int:
    """Brings one part's entries and bounds up to date in place; the number of vectors that took a full scan."""
    entries, moved = books.entries[part], books.moved[part]
    upper += moved[code]
    order = np.argsort(moved)
    most, second = moved[order[-1]], moved[order[-2]] if len(moved) > 1 else 0.0
    lower -= np.where(code == order[-1], second, most)
    limit = np.maximum(lower, books.near[part][code])
    open_ = np.flatnonzero(~(upper < limit))
    if len(open_):
        upper[open_] = np.sqrt(((x[open_] - entries[code[open_]]) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        open_ = open_[~(upper[open_] < limit[open_])]
    if len(open_):
        code[open_], upper[open_], lower[open_] = scan(x[open_], entries)
    return len(open_)


STATE = "vec_id long, label long, v binary, code binary, upper binary, lower binary, scanned long"


def advance(state: DataFrame, books: Codebooks, first: bool) -> DataFrame:
    """The state under new codebooks. ``first``: no bounds yet, so all parts are scanned."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(at, AT_ONCE)
                n = rows.num_rows
                x = matrix(rows.column(2).to_pylist(), parts * width).reshape(n, parts, width).astype(np.int64)
                if first:
                    code, upper, lower = np.zeros((parts, n), np.uint8), np.full((parts, n), np.inf), np.zeros((parts, n))
                else:
                    code, upper, lower = (np.frombuffer(b"".join(rows.column(k).to_pylist()), kind).reshape(n, parts).T.copy() for k, kind in ((3, "u1"), (4, "<f8"), (5, "<f8")))
                scanned = sum(assign(x[:, p], books, code[p], upper[p], lower[p], p) for p in range(parts))
                cells = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(a.shape[0] * a.itemsize), n, [None, pa.py_buffer(np.ascontiguousarray(a.T).tobytes())]).cast(pa.binary()) for a in (code, upper, lower)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], *cells, pa.array(np.r_[scanned, np.zeros(n - 1, np.int64)])], [f.split()[0] for f in STATE.split(", ")])

    return state.mapInArrow(run, STATE)


def sums(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each part and entry the sum of its parts and their number. Tasks sum first, then Spark by entry."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(at, AT_ONCE)
                n = rows.num_rows
                x = matrix(rows.column(0).to_pylist(), parts * width).reshape(n, parts, width)
                code = np.frombuffer(b"".join(rows.column(1).to_pylist()), "u1").reshape(n, parts)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], np.c_[x[:, p], np.ones(n, np.int64)].astype(np.int64))
        used = np.argwhere(total[:, :, -1] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array([total[p, e].tolist() for p, e in used], pa.list_(pa.int64()))], ["part", "entry", "sums"])

    each = state.select("v", "code").mapInArrow(run, "part int, entry int, sums array<long>").select("part", "entry", F.posexplode("sums").alias("at", "x"))
    total = np.zeros((parts, entries, width + 1), np.int64)
    for r in each.groupBy("part", "entry", "at").agg(F.sum("x").alias("x")).collect():  # PARTS * ENTRIES * (width + 1) rows
        total[r["part"], r["entry"], r["at"]] = r["x"]
    return total[:, :, :-1], total[:, :, -1]


def starting(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks of the first vectors by id: part, entry, position."""
    width = rows.agg(F.max(F.octet_length("v"))).first()[0]
    width = -(-(width or 0) // (4 * parts))
    first = [r["v"] for r in rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    return matrix([bytes(v) for v in first], parts * width).reshape(len(first), parts, width).transpose(1, 0, 2).astype(np.int64)


def compress(work: Workspace, df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The state after the last assignment, as a table of ``work``, and the codebooks. df: vec_id, label, embedding. Up to 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("an index is one byte")
    labelled = df.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    rows = work.put(quantised(labelled, FACTOR, "embedding", "vec_id", "label"), "vectors")
    book = starting(rows, parts, entries)
    empty = F.lit(b"")
    if not book.size:  # no vector, or none with a component: all are the first entry
        return rows.select("*", F.lit(bytes(parts)).alias("code"), empty.alias("upper"), empty.alias("lower"), F.lit(0).cast("long").alias("scanned")), book
    books, state = Codebooks.of(book), rows.select("*", empty.alias("code"), empty.alias("upper"), empty.alias("lower"), F.lit(0).cast("long").alias("scanned"))
    before = rows
    for k in range(rounds + 1):
        state = work.put(advance(state, books, k == 0), f"round{k}")
        work.drop(before)
        before = state
        if k < rounds:
            total, n = sums(state, books.entries.shape)
            moved = np.where(n[:, :, None] > 0, total // np.maximum(n, 1)[:, :, None], books.entries)
            books = Codebooks.of(moved, books.entries)
    return state, books.entries


def report(spark: SparkSession, df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, the codebooks' digest and the number of full scans so far in the last round's batch of the row."""
    work = Workspace(spark, "codes")
    state, book = compress(work, df)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    parts, _, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(at, AT_ONCE)
                n = rows.num_rows
                x = matrix(rows.column(2).to_pylist(), parts * width).reshape(n, parts, width).astype(np.int64)
                code = np.frombuffer(b"".join(rows.column(3).to_pylist()), "u1").reshape(n, parts)
                error = sum(((x[:, p] - book[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array([c.hex() for c in rows.column(3).to_pylist()], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = state.select("vec_id", "label", "v", "code").mapInArrow(run, "vec_id long, label long, code string, error long")
    coded = work.put(coded.select("*", F.isnull("label").alias("unlabelled"), F.coalesce("label", F.lit(0).cast("long")).alias("of")), "coded")
    by = ["unlabelled", "of"]
    errors = work.put(coded.groupBy(*by).agg(F.sum("error").alias("label_error")), "labels")
    out = attach(coded, errors, by, "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = 8) -> str:
    """The same in SQL for vectors of parts * width components, every distance computed in every round."""
    lists = f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, q.p, list_slice(v, {width} * q.p + 1, {width} * q.p + {width}) AS v FROM kept, (SELECT unnest(range({parts})) AS p) q),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM p WHERE r <= {entries})"""
    steps = [lists]
    far = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, d // {entries} AS error, d % {entries} AS e FROM (SELECT p.r, p.p, min(CAST({far} AS BIGINT) * {entries} + b.e) AS d FROM p JOIN b{k} b ON p.p = b.p GROUP BY p.r, p.p))")
        if k < rounds:
            means = ", ".join(f"CAST(floor(CAST(sum(p.v[{i}]) AS DOUBLE) / count(*)) AS BIGINT)" for i in range(1, width + 1))
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT a.p, a.e, [{means}] AS v FROM a{k} a JOIN p ON a.r = p.r AND a.p = p.p GROUP BY a.p, a.e) m ON m.p = b.p AND m.e = b.e)")
    return f"""WITH {', '.join(steps)},
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM kept JOIN c USING (r)"""
