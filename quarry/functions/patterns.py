"""Row patterns over a key's events: a small automaton that runs over rows in order of time, all starts of an Arrow batch at once.

A pattern is a list of steps; each has a name, the kinds of rows that it takes, and whether it takes one row or more. A match is a stretch of neighbouring rows
of one key that goes through all steps within a time; it starts at any row, and of matches from one row the shortest counts. The sets of steps that a start may be in
are numbers, and what a row's kind makes of each is a table. Each round moves all starts that can still match by one row; those at the end of a batch go on in the next, so
a key's history of any length streams through, and only open starts are held.

``match`` deals each key's rows over slices of time as well. A slice also gets the rows that follow it within the longest time of a match, and starts no match
there, so each match is found in one slice, whole; a hot key is many tasks'.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


#: A row's id, which may be null.
ID = np.dtype([("id", "<i8"), ("null", "?")])


@dataclass(frozen=True)
class Step:
    name: str
    kinds: tuple[str, ...]
    many: bool = False


def advance(steps: Sequence[Step], at: int, kind: str) -> set[int]:
    """Steps in which a match that is in step ``at`` (-1: not begun) may be after a row of this kind."""
    out = set()
    if at >= 0 and steps[at].many and kind in steps[at].kinds:
        out.add(at)
    if at + 1 < len(steps) and kind in steps[at + 1].kinds:
        out.add(at + 1)
    return out


def transitions(steps: Sequence[Step]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """A number for each kind (0 for all others); for each set of steps and kind the set after it, and whether it ends a match. Set 0 is empty, 1 has not begun."""
    kinds = {k: n for n, k in enumerate(sorted({k for s in steps for k in s.kinds}), 1)}
    sets, after, ends = [frozenset(), frozenset({-1})], [], []
    for held in sets:  # grows as sets are reached
        moved = [set().union(*(advance(steps, s, k) for s in held)) for k in ("", *kinds)] if held else [set()] * (len(kinds) + 1)
        moved[0] = set()
        ends.append([len(steps) - 1 in m for m in moved])
        moved = [frozenset() if end else frozenset(m) for m, end in zip(moved, ends[-1], strict=True)]
        sets += [m for m in dict.fromkeys(moved) if m not in sets]
        after.append([sets.index(m) for m in moved])
    return kinds, np.array(after), np.array(ends)


def matcher(steps: Sequence[Step], within_us: int):
    """The function for mapInArrow of a pattern. Its rows: k, slice, at (microseconds), id, kind, fresh (whether a match may start there), those of a k and slice together."""
    kinds, after, ends = transitions(steps)
    names = pa.array(list(kinds))

    def ids(x: np.ndarray) -> pa.Array:
        return pa.array(np.ascontiguousarray(x["id"]), mask=np.ascontiguousarray(x["null"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each open start: id, time, rows so far, and set of steps. group: the k and slice of the last row.
        none = np.empty(0, ID), *(np.empty(0, np.int64) for _ in range(3))
        (first, since, n, state), group = none, None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            k, part = batch.column(0), batch.column(1)
            at, row_id = batch.column(2).to_numpy(), np.empty(rows, ID)
            row_id["id"], row_id["null"] = pc.fill_null(batch.column(3), 0).to_numpy(), batch.column(3).is_null().to_numpy(zero_copy_only=False)
            kind = pc.fill_null(pc.add(pc.index_in(batch.column(4), names), 1), 0).to_numpy(zero_copy_only=False)
            new = np.r_[group != (k[0].as_py(), part[0].as_py()), np.zeros(rows - 1, bool)]
            if rows > 1:
                new[1:] = pc.or_(pc.not_equal(k[1:], k[:-1]), pc.not_equal(part[1:], part[:-1])).to_numpy(zero_copy_only=False)
            group = (k[rows - 1].as_py(), part[rows - 1].as_py())
            end = np.append(np.flatnonzero(new), rows)  # where each row's own group ends
            end = end[np.searchsorted(end, np.arange(rows), "right")]
            begins = np.flatnonzero(batch.column(5).to_numpy(zero_copy_only=False) & ((after[1] != 0) | ends[1])[kind])
            if new[0]:
                first, since, n, state = (x[:0] for x in (first, since, n, state))
            place, stop = np.r_[np.zeros(len(first), np.int64), begins], np.r_[np.full(len(first), end[0]), end[begins]]
            first, since, n, state = np.r_[first, row_id[begins]], np.r_[since, at[begins]], np.r_[n, np.zeros(len(begins), np.int64)], np.r_[state, np.ones(len(begins), np.int64)]
            found, waiting = [], []
            while len(place):
                kept = at[place] - since <= within_us
                hit = kept & ends[state, kind[place]]
                if hit.any():
                    found.append((place[hit], first[hit], n[hit] + 1))
                state = after[state, kind[place]]
                kept &= ~hit & (state != 0)
                place, stop, first, since, n, state = (x[kept] for x in (place + 1, stop, first, since, n + 1, state))
                over = place == stop
                if over.any():
                    last = over & (place == rows)  # the group may go on in the next batch
                    waiting.append((first[last], since[last], n[last], state[last]))
                    place, stop, first, since, n, state = (x[~over] for x in (place, stop, first, since, n, state))
            first, since, n, state = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else none
            if found:
                place, starts, many = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([k.take(pa.array(place)), ids(starts), ids(row_id[place]), pa.array(many.astype(np.int32))], ["k", "first_id", "last_id", "n_rows"])

    return run


def match(df: DataFrame, steps: Sequence[Step], key: str, at: str, row_id: str, kind: str, within_seconds: int, slice_seconds: int | None = None) -> DataFrame:
    """k (the key as text), first_id, last_id and n_rows of each match. Rows are in order of time, then id. Rows without key or time take no part; a null kind is in no step."""
    if not steps or within_seconds <= 0:
        raise ValueError("a pattern has steps and a time")
    within = within_seconds * 1_000_000
    size = max(slice_seconds or 0, within_seconds) * 1_000_000
    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(row_id).cast("long").alias("id"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("kind"))
    own = F.floor(F.col("at") / size)
    # In its own slice, and in the one before if a match from there may reach it: slices are no shorter than a match.
    places = F.when(F.col("at") - own * size <= within, F.array(own, own - 1)).otherwise(F.array(own))
    dealt = rows.withColumn("slice", F.explode(places)).withColumn("fresh", F.col("slice") == own)
    ordered = dealt.select("k", "slice", "at", "id", "kind", "fresh").repartition("k", "slice").sortWithinPartitions("k", "slice", "at", "id")
    return ordered.mapInArrow(matcher(steps, within), "k string, first_id long, last_id long, n_rows int")
