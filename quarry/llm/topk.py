"""Exact top-k search by inner product: three phases with a uniform threshold over score lists by part of the vectors.

Vectors of integers are cut into PARTS parts. A part's products with a query are a list of partial scores; a score is their sum. Lists stay
where they are computed, in cells: a block of queries, a range of candidates, one part.

1. Each cell gives the DEPTH best entries of its list for each query. Their other partial scores are asked from the other lists, and the
   k-th best sum of a query is a cutoff that its k-th best score can't be below.
2. The cutoff goes to all lists of the query. A sum that reaches it has a part of at least cutoff / PARTS, so entries of that many
   and more, of all lists, hold every answer; ties included.
3. What the collected entries lack is asked from the lists that have it. Sums are exact then; those that reach the cutoff are ranked.

Equal vectors are one candidate and one query: a class, with its k + 1 smallest ids. So a vector that stands in a third of all rows is one entry of each list.
A query's own row is left out at the end: k + 1 are searched for.

Every query meets every candidate in products of blocks, as an exact search over inner products must; no list leaves its cell but for its best entries,
those over the cutoff and those asked for. A task holds a block of queries, one of candidates and their products, whatever the input.

Rows: vectors that are null or hold null or non-finite components take no part, nor do those with an integer beyond ``vectors.LARGEST``. Shorter vectors
count as ending in zeros; an empty one scores 0 with all. Vectors of up to 2,000 components can't pass 64 bits. A row with a null id is a candidate, last of equal scores, and no query. Repeated ids are rows of their own:
each is a query, and leaves out one row of its id and vector. An empty table, or one without a query, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.llm.common import Workspace, attach
from quarry.llm.vectors import matrix, quantised

FACTOR, TOP, EVERY = 64, 20, 20
PARTS = 2
#: Best entries of a list, in multiples of k + 1, over all ranges of candidates together (k + 1 for each at least).
DEPTH = 8
#: Classes of a block of queries, of candidates, and blocks of candidates in a cell.
QUERIES, BLOCK, RANGE = 512, 2048, 32
NONE = np.iinfo(np.int64).min

CELL = "qblock int, cells int, part int, block int, kind int, a binary, b binary"
PAIRS = "qblock int, block int, part int, q binary, pos binary, score binary"


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, in the fastest type that is exact."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return q.astype(kind) @ c.astype(kind).T


def unpacked(data: bytes, width: int) -> np.ndarray:
    """Vectors of a block's part, as ``packed`` stores them: a byte each where all are empty."""
    return np.frombuffer(data, "<i4").reshape(-1, width) if width else np.zeros((len(data), 0), np.int32)


def pair_rows(out: list[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of PAIRS; places as 16-bit, scores as 64-bit integers."""
    ints = [pa.array([r[k] for r in out], pa.int32()) for k in range(3)]
    cells = [pa.array([r[k].astype(kind).tobytes() for r in out], pa.binary()) for k, kind in ((3, "<u2"), (4, "<u2"), (5, "<i8"))]
    return pa.RecordBatch.from_arrays([*ints, *cells], [f.split()[0] for f in PAIRS.split(", ")])


def in_cells(rows: DataFrame, each: Callable[[tuple[int, int, int], np.ndarray, Iterator[tuple[int, int, bytes, bytes]], int], Iterator[pa.RecordBatch]], width: int) -> DataFrame:
    """``each`` over the rows of a cell: its key, its queries' part, then block, kind and data of the others in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple[tuple[int, int, int], tuple[int, int, bytes, bytes]]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    q, at, part, block, kind, a, b = (batch.column(k)[i].as_py() for k in range(7))
                    yield (q, at, part), (block, kind, a, b)

        rows_of = cells()
        ahead = next(rows_of, None)

        def same(key: tuple[int, int, int]) -> Iterator[tuple[int, int, bytes, bytes]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                row, ahead = ahead[1], next(rows_of, None)
                yield row

        while ahead is not None:
            key = ahead[0]
            own = same(key)
            _, _, a, _ = next(own)
            yield from each(key, unpacked(a, width), own, key[2])
            for _ in own:
                pass

    order = ["qblock", "cells", "part"]
    return rows.repartition(*order).sortWithinPartitions(*order, "block", "kind").mapInArrow(run, PAIRS)


def packed(rows: DataFrame, width: int) -> DataFrame:
    """rows: block, pos, v, with places from 0 on in each block. For each block and part one row: block, part and the parts of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block_rows(block: int, cells: list[bytes]) -> pa.RecordBatch:
            x = matrix(cells, PARTS * width).reshape(len(cells), PARTS, width)
            data = [np.ascontiguousarray(x[:, p]).tobytes() if width else b"\0" * len(cells) for p in range(PARTS)]
            return pa.RecordBatch.from_arrays([pa.array([block] * PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()), pa.array(data, pa.binary())], ["block", "part", "a"])

        now, cells = None, []
        for batch in batches:
            for block, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now:
                    if cells:
                        yield block_rows(now, cells)
                    now, cells = block, []
                cells.append(v)
        if cells:
            yield block_rows(now, cells)

    return rows.repartition("block").sortWithinPartitions("block", "pos").select("block", "v").mapInArrow(run, "block int, part int, a binary")


def in_blocks(rows: DataFrame, n: int, size: int) -> DataFrame:
    """rows (distinct v) with a block, and a place within it. Blocks of about ``size`` by hash, so far below the 65,536 places that 16 bits can name."""
    x = rows.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(max(1, math.ceil(n / size)))).cast("int"))
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy("v")) - 1)


class Search:
    """The tables of one search: classes of candidates and of queries, and their parts in blocks."""

    def __init__(self, work: Workspace, rows: DataFrame, k: int, every: int):
        """rows: vec_id and v."""
        self.work, self.k = work, k
        order = [F.col("vec_id").asc_nulls_last()]
        first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy(*order))).where(F.col("rank") <= k + 1)
        groups = work.put(first.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("ids")), "classes")
        self.n = groups.count()
        self.classes = work.put(in_blocks(groups, self.n, BLOCK), "placed")
        asked = rows.where(F.col("vec_id").isNotNull() & (F.pmod("vec_id", F.lit(every)) == 0))
        self.asked = work.put(attach(asked, self.classes.select("v", "block", "pos"), ["v"], "vec_id").select("vec_id", "block", "pos", "v"), "asked")
        queries = self.asked.select("v", "block", "pos").distinct().withColumnsRenamed({"block": "own_block", "pos": "own_pos"})
        self.n_queries = queries.count()
        self.queries = work.put(in_blocks(queries, self.n_queries, QUERIES).withColumnsRenamed({"block": "qblock", "pos": "q"}), "queries")
        longest = groups.agg(F.max(F.octet_length("v"))).first()[0] or 0
        self.width = -(-longest // (4 * PARTS))
        self.c = work.put(packed(self.classes, self.width), "candidate-parts")
        self.q = work.put(packed(self.queries.withColumnsRenamed({"qblock": "block", "q": "pos"}), self.width), "query-parts")
        self.qblocks, self.ranges = (max(1, math.ceil(self.n_queries / QUERIES)), max(1, math.ceil(max(1, math.ceil(self.n / BLOCK)) / RANGE)))
        work.drop(groups)

    def cells(self) -> DataFrame:
        """The rows of all cells: each block of queries once for each range, each block of candidates once for each block of queries."""
        nothing = F.lit(None).cast("binary")
        to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = self.q.select(F.col("block").alias("qblock"), to(self.ranges).alias("cells"), "part", F.lit(-1).alias("block"), F.lit(0).alias("kind"), "a", nothing.alias("b"))
        c = self.c.select(to(self.qblocks).alias("qblock"), F.floor(F.col("block") / RANGE).cast("int").alias("cells"), "part", "block", F.lit(1).alias("kind"), "a", nothing.alias("b"))
        return q.union(c)

    def gathered(self) -> DataFrame:
        """Phase 1: the best entries of each list."""
        width, depth = self.width, max(self.k + 1, math.ceil(DEPTH * (self.k + 1) / self.ranges))

        def each(key: tuple[int, int, int], q: np.ndarray, rows: Iterator, part: int) -> Iterator[pa.RecordBatch]:
            best, at = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
            for block, _, a, _ in rows:
                c = unpacked(a, width)
                score = products(q, c)
                place = np.broadcast_to(np.arange(len(c)) + (block << 16), score.shape)
                if score.shape[1] > depth:
                    cut = np.argpartition(score, -depth, 1)[:, -depth:]
                    score, place = np.take_along_axis(score, cut, 1), np.take_along_axis(place, cut, 1)
                best, at = np.concatenate([best.astype(score.dtype) if not best.size else best, score], 1), np.concatenate([at, place], 1)
                if best.shape[1] > depth:
                    cut = np.argpartition(best, -depth, 1)[:, -depth:]
                    best, at = np.take_along_axis(best, cut, 1), np.take_along_axis(at, cut, 1)
            owner = np.repeat(np.arange(len(q)), best.shape[1])
            best, at = best.ravel(), at.ravel()
            order = np.argsort(at >> 16, kind="stable")
            owner, best, at = owner[order], best[order], at[order]
            for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at >> 16)) + 1):
                if len(cut):
                    yield pair_rows([(key[0], int(at[cut[0]] >> 16), part, owner[cut], at[cut] & 0xFFFF, best[cut])])

        return in_cells(self.cells(), each, width)

    def over(self, cutoffs: DataFrame) -> DataFrame:
        """Phase 2: entries of each list that reach their part of the query's cutoff. cutoffs: qblock, and a 64-bit cutoff for each of its places."""
        width, parts = self.width, PARTS
        spread = F.explode(F.expr(f"flatten(transform(sequence(0, {self.ranges - 1}), c -> transform(sequence(0, {PARTS - 1}), p -> struct(c AS cells, p AS part))))"))
        sent = cutoffs.select("qblock", spread.alias("to"), "a").select("qblock", "to.cells", "to.part", F.lit(-1).alias("block"), F.lit(1).alias("kind"), "a", F.lit(None).cast("binary").alias("b"))

        def each(key: tuple[int, int, int], q: np.ndarray, rows: Iterator, part: int) -> Iterator[pa.RecordBatch]:
            least = np.full(len(q), NONE)
            for block, _, a, _ in rows:
                if block < 0:
                    cut = np.frombuffer(a, "<i8")
                    least = np.where(cut == NONE, NONE, -(-cut // parts))
                    continue
                c = unpacked(a, width)
                score = products(q, c)
                i, j = np.nonzero(score >= (least if score.dtype == np.int64 else least.astype(np.float64))[:, None])
                if len(i):
                    yield pair_rows([(key[0], block, part, i, j, score[i, j])])

        return in_cells(self.cells().union(sent), each, width)

    def answers(self, entries: DataFrame) -> DataFrame:
        """The partial scores that the other lists have for these entries."""
        width = self.width
        others = F.explode(F.expr(f"filter(sequence(0, {PARTS - 1}), p -> p <> part)"))
        asked = entries.select("qblock", F.floor(F.col("block") / RANGE).cast("int").alias("cells"), others.alias("part"), "block", F.lit(2).alias("kind"), F.col("q").alias("a"), F.col("pos").alias("b"))

        def each(key: tuple[int, int, int], q: np.ndarray, rows: Iterator, part: int) -> Iterator[pa.RecordBatch]:
            c = None
            for block, kind, a, b in rows:
                if kind == 1:
                    c = unpacked(a, width)
                    continue
                i, j = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
                score = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 65536]].astype(np.int64), c[j[s : s + 65536]].astype(np.int64)) for s in range(0, len(i), 65536)])
                yield pair_rows([(key[0], block, part, i, j, score)])

        return in_cells(self.cells().union(asked), each, width)

    def sums(self, entries: DataFrame, answers: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
        """qblock, q, block, pos and score of each pair of entries, once; with cutoffs those that reach them, else the k + 1 best of each query and block."""
        most = self.k + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def total(key: tuple[int, int], rows: list[tuple[int, bytes, bytes, bytes]], cut: np.ndarray | None) -> pa.RecordBatch:
                part = np.concatenate([np.full(len(q) // 2, p) for p, q, _, _ in rows])
                q, pos, score = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in ((1, "<u2"), (2, "<u2"), (3, "<i8")))
                pair = q.astype(np.int64) << 16 | pos
                order = np.lexsort((part, pair))
                pair, part, score = pair[order], part[order], score[order]
                once = np.r_[True, (pair[1:] != pair[:-1]) | (part[1:] != part[:-1])]  # found by a list and asked from it
                pair, score = pair[once], score[once]
                start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                pair, score = pair[start], np.add.reduceat(score, start)
                if cut is not None:
                    ok = score >= cut[pair >> 16]
                else:
                    order = np.lexsort((-score, pair >> 16))
                    owner = (pair >> 16)[order]
                    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    ok = np.zeros(len(pair), bool)
                    ok[order] = np.arange(len(pair)) - np.repeat(begins, np.diff(np.r_[begins, len(pair)])) < most
                pair, score = pair[ok], score[ok]
                columns = [np.full(len(pair), key[0], np.int32), (pair >> 16).astype(np.int32), np.full(len(pair), key[1], np.int32), (pair & 0xFFFF).astype(np.int32), score]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["qblock", "q", "block", "pos", "score"])

            now, rows, cut = None, [], None
            for batch in batches:
                for qblock, block, part, q, pos, score, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (qblock, block) != now:
                        if rows:
                            yield total(now, rows, cut)
                        now, rows, cut = (qblock, block), [], None
                    rows.append((part, q, pos, score))
                    cut = np.frombuffer(least, "<i8") if least is not None else cut
            if rows:
                yield total(now, rows, cut)

        both = entries.union(answers)
        both = attach(both, cutoffs.withColumnRenamed("a", "least"), ["qblock"], "block") if cutoffs is not None else both.withColumn("least", F.lit(None).cast("binary"))
        ordered = both.select("qblock", "block", "part", "q", "pos", "score", "least").repartition("qblock", "block").sortWithinPartitions("qblock", "block", "part")
        return ordered.mapInArrow(run, "qblock int, q int, block int, pos int, score long")

    def cutoffs(self, gathered: DataFrame, answers: DataFrame) -> DataFrame:
        """qblock and the cutoffs of its queries in order, as 64-bit integers: the score of the last of k + 1; the least number where there aren't so many."""
        own = Window.partitionBy("qblock", "q").orderBy(F.col("score").desc(), "block", "pos")
        best = self.sums(gathered, answers).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= self.k + 1)
        last = best.groupBy("qblock", "q").agg(F.when(F.count("*") == self.k + 1, F.min("score")).alias("cutoff"))
        cells = last.groupBy("qblock").agg(F.array_sort(F.collect_list(F.struct("q", "cutoff"))).alias("all"))  # QUERIES or so

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = [np.array([NONE if x["cutoff"] is None else x["cutoff"] for x in every], "<i8").tobytes() for every in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["qblock", "a"])

        return cells.mapInArrow(run, "qblock int, a binary")

    def best(self) -> DataFrame:
        """own_block, own_pos, block, pos and score: at least the k + 1 best classes of each query's class."""
        work = self.work
        gathered = work.put(self.gathered(), "gathered")
        cutoffs = work.put(self.cutoffs(gathered, self.answers(gathered)), "cutoffs")
        over = work.put(self.over(cutoffs), "over")
        found = self.sums(over, self.answers(over), cutoffs)
        own = self.queries.select("qblock", "q", "own_block", "own_pos")
        out = work.put(attach(found, own, ["qblock", "q"], "pos").drop("qblock", "q"), "found")
        work.drop(gathered, cutoffs, over)
        return out


def search(spark: SparkSession, df: DataFrame, k: int = TOP, every: int = EVERY, factor: int = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for each row whose id is divisible by ``every``. df: vec_id and embedding."""
    work = Workspace(spark, "topk")
    rows = work.put(quantised(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), factor, "embedding", "vec_id", strip=True), "vectors")
    s = Search(work, rows, k, every)
    if not s.n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    here = ["own_block", "own_pos"]
    named = attach(s.best(), s.classes.select("block", "pos", "ids"), ["block", "pos"], "own_pos")
    # Classes in order of their first ids, as many as there are places; then their rows.
    own = Window.partitionBy(*here)
    first = own.orderBy(F.col("score").desc(), F.col("ids")[0].asc_nulls_last(), "block", "pos")
    some = named.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
    every_row = some.select(*here, "score", ((F.col("block") == F.col("own_block")) & (F.col("pos") == F.col("own_pos"))).alias("own"), F.explode("ids").alias("vec_id"))
    order = own.orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "own")
    top = every_row.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    lists = top.groupBy(*here).agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "own"))).alias("all"))
    lists = work.put(lists.withColumnsRenamed({"own_block": "block", "own_pos": "pos"}), "lists")
    each = attach(s.asked.select(F.col("vec_id").alias("query_id"), "block", "pos"), lists, ["block", "pos"], "query_id")
    # The query's own row: the first of its class that has its id. If it isn't among them, the last goes.
    itself = F.coalesce(F.get(F.filter("all", lambda x: x["own"] & x["vec_id"].eqNullSafe(F.col("query_id"))), F.lit(0))["rank"], F.lit(k + 1))
    rest = F.filter("all", lambda x: x["rank"] != F.col("itself"))
    shown = each.withColumn("itself", itself).select("query_id", F.posexplode(rest).alias("place", "x"))
    return shown.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def sql(k: int = TOP, every: int = EVERY, factor: int = FACTOR) -> str:
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({factor} * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
