"""Vectors of floats as vectors of integers, shared by exact search and code compression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Integers beyond this would let sums of products pass 64 bits; vectors that have one take no part.
LARGEST = 2**26


def quantised(df: DataFrame, factor: int, vector: str = "embedding", *keep: str, strip: bool = False) -> DataFrame:
    """The kept columns and ``v``: floor(factor * x) of each component x as a double, as 32-bit little-endian bytes; with ``strip`` without zeros at the end.

    Rows take no part whose vector is null, holds a null or a non-finite component, or one whose integer is beyond LARGEST.
    """
    source = df.select(*keep, df[vector].cast("array<double>").alias("v"))
    schema = source.drop("v").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = part.column(len(keep))
                lengths = np.where(vectors.is_null().to_numpy(zero_copy_only=False), 0, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                values = vectors.flatten()
                x = np.floor(np.asarray(values.fill_null(np.nan), np.float64) * factor)
                bad = ~(np.abs(x) <= LARGEST)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                ok = vectors.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(owner, bad, len(lengths)) == 0)
                cut = np.cumsum(lengths)
                ints = np.where(bad, 0, x).astype("<i4").tobytes()
                cells = [ints[4 * (e - n) : 4 * e] for e, n in zip(cut.tolist(), lengths.tolist(), strict=True)]
                if strip:
                    cells = [c.rstrip(b"\0") for c in cells]
                    cells = [c.ljust(-(-len(c) // 4) * 4, b"\0") for c in cells]
                out = pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(cells, pa.binary())], [*keep, "v"])
                yield out.filter(pa.array(ok))

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "v binary"]))


def matrix(cells: list[bytes], width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones end in zeros."""
    if all(len(c) == 4 * width for c in cells):
        return np.frombuffer(b"".join(cells), "<i4").reshape(len(cells), width)
    return np.frombuffer(b"".join(c.ljust(4 * width, b"\0") for c in cells), "<i4").reshape(len(cells), width)
