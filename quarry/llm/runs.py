"""Periodic runs of words by probing a harmonic grid, and texts with their repetitions collapsed.

A run is a stretch of words that has a smallest period q (words q apart are identical), is at least max(6, 4q) words long,
and that no neighbouring word extends with that period.

1. Where words i and i + p are equal for a whole stretch of 3p or more, three neighbouring points jp of the grid of p lie in it, so the
   words at jp, (j+1)p, (j+2)p and (j+3)p are the same. Testing that for all p takes n/p comparisons each, n log n together: long periods
   for all p at once, point by point; short ones for all points at once, period by period.
2. Survivors are tested at three more places that the stretch must hold, then extended to both sides by comparing growing chunks.
3. Grid points whose whole probe lies within a run found before, of the same or a shorter period, are skipped: by Fine and Wilf a run
   of a longer smallest period can't hold them.

Periods rise, and stretches that are periodic in a multiple of a run's period are that run, so each interval is kept with its first period.

Rows: a null text has no words. A null id leaves ``planted`` texts as they are. Empty texts, texts of few words, ties and repeated rows are
rows like any other; each is done alone, whole, whatever its length. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import text_bytes

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4
#: Grid points from which a period is probed by itself.
POINTS = 64
#: Words that an extension compares first; each next chunk is twice as long, up to the second number.
CHUNK, LONGEST = 64, 65_536


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def probes(w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods and grid points (jp) where four words of the grid in a row are the same; periods may come in any order."""
    n = len(w)
    most = (n - 1) // (PERIODS - 1)  # the last word of the first probe is 3p
    most = min(most, n // PERIODS)
    alone = min(n // POINTS, most)
    for p in range(1, alone + 1):
        grid = w[::p]
        same = grid[:-1] == grid[1:]
        hit = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(hit):
            yield np.full(len(hit), p), hit * p
    first = alone + 1
    j, at = 0, [np.full(max(most - first + 1, 0), w[0] if n else 0)]

    def column(k: int) -> np.ndarray:
        """Words k * p of each period p from ``first``, as far as the text goes."""
        return w[k * first :: k][: most - first + 1]

    at += [column(k) for k in (1, 2, 3)]
    while len(at[3]) and most >= first:
        m = len(at[3])
        hit = np.flatnonzero((at[0][:m] == at[1][:m]) & (at[1][:m] == at[2][:m]) & (at[2][:m] == at[3]))
        if len(hit):
            yield hit + first, (hit + first) * j
        j += 1
        at = [*at[1:], column(j + 3)]


def stretch(w: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The longest stretch of period p around the equal words ``at`` and at + p: start and end."""
    n, end, size = len(w), at + 1, CHUNK
    while end < n - p:
        to = min(end + size, n - p)
        off = w[end:to] != w[end + p : to + p]
        if off.any():
            end += int(off.argmax())
            break
        end, size = to, min(2 * size, LONGEST)
    start, size = at, CHUNK
    while start:
        to = max(start - size, 0)
        off = (w[to:start] != w[to + p : start + p])[::-1]
        if off.any():
            start -= int(off.argmax())
            break
        start, size = to, min(2 * size, LONGEST)
    return start, end + p


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length and smallest period of each run, by start, then period."""
    n = len(w)
    if n < LEAST:
        return []
    found = list(probes(w))
    if not found:
        return []
    ps, gs = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    for place in (lambda p: np.minimum(1, p), lambda p: p // 2, lambda p: p - 1):
        inner = gs + place(ps)
        ok = w[inner] == w[inner + ps]
        ps, gs = ps[ok], gs[ok]
    order = np.lexsort((gs, ps))
    ps, gs = ps[order], gs[order]
    covered = np.zeros(n, np.int64)  # the furthest end of a run that holds the word
    runs: dict[tuple[int, int], int] = {}
    for a, b in zip(*(x.tolist() for x in bounds(ps)), strict=True):
        p = int(ps[a])
        points = gs[a:b]
        left = points[covered[points] <= points + (PERIODS - 1) * p].tolist()
        for g in left:
            if covered[g] > g + (PERIODS - 1) * p:
                continue
            start, end = stretch(w, g, p)
            if end - start >= max(LEAST, PERIODS * p) and (start, end) not in runs:
                runs[start, end] = p
                np.maximum(covered[start:end], end, out=covered[start:end])
    return sorted((start, end - start, p) for (start, end), p in runs.items())


def bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of equal neighbours."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return start, np.r_[start[1:], len(keys)].astype(np.int64) if len(keys) else start


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether a run holds the word after the run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        edge[start + p] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In one text of ten, by the CRC of its id, all words from some place on repeat with a period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * -(-(n - a) // p))[: n - a]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def text_row(doc_id: int | None, text: bytes, plant: bool) -> tuple:
    words = text.split()  # of bytes: ASCII white space
    if plant:
        words = planted(doc_id, words)
    runs = find_runs(word_numbers(words))
    drop = repeated(len(words), runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = [*best, 1000 * best[1] // best[2]] if best else [None] * 4
    start, length, period, exponent = told
    said = hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest()
    kept = b" ".join(x for x, out in zip(words, drop.tolist(), strict=True) if not out) if runs else b" ".join(words)
    return doc_id, len(runs), start, length, period, exponent, said, hashlib.sha256(kept).hexdigest(), len(words), int(drop.sum())


def report(df: DataFrame, plant: bool = True) -> DataFrame:
    """A row for each text: number of runs, the longest one, digests of all runs and of the text without repetitions. ``plant`` repeats words first, see ``planted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in SCHEMA.split(", ")])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [text_row(i, t.as_py(), plant) for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return text_bytes(df, "doc_id").mapInArrow(run, SCHEMA)


def spans(df: DataFrame) -> DataFrame:
    """A row for each run of each text: doc_id, start, length and period in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = find_runs(word_numbers(text.as_py().split()))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(runs), pa.int64()), *(pa.array([r[k] for r in runs], pa.int64()) for k in range(3))], ["doc_id", "start", "length", "period"])

    return text_bytes(df, "doc_id").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed(df: DataFrame) -> DataFrame:
    """doc_id and the text with each run cut to its first period, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for text in batch.column(1).slice(at, 256):
                    words = text.as_py().split()
                    drop = repeated(len(words), find_runs(word_numbers(words)))
                    out.append(b" ".join(x for x, gone in zip(words, drop.tolist(), strict=True) if not gone).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(out, pa.string())], ["doc_id", "text"])

    return text_bytes(df, "doc_id").mapInArrow(run, "doc_id long, text string")
