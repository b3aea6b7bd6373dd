"""Streams with late, repeated and out-of-order rows, restarts and replays, each against the batch answer."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry import operators, streaming
from quarry.sources import table

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def files(spark, folder, batches):
    """Each list of rows as one file, read in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}-{k}")
        import glob
        import os
        import shutil

        os.makedirs(folder, exist_ok=True)
        (found,) = glob.glob(f"{folder}-{k}/*.parquet")
        to = f"{folder}/part-{len(os.listdir(folder)):03d}.parquet"
        shutil.move(found, to)
        stamp = 1_700_000_000 + len(os.listdir(folder))
        os.utime(to, (stamp, stamp))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def shuffled(seed, n=400):
    """Rows in four batches: out of order by up to ten minutes, some twice; and a last row far ahead that closes all sessions."""
    rnd = random.Random(seed)
    rows = [(k, START + timedelta(seconds=30 * k + rnd.randrange(30)), rnd.randrange(6), rnd.choice(["view", "view", "purchase", "click"])) for k in range(n)]
    order = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rnd.randrange(500)))
    order += rnd.sample(order[-20:], 10)
    batches = [order[k * n // 4 : (k + 1) * n // 4] for k in range(4)]
    batches[3] += order[n:]
    return rows, [*batches, [(10**6, START + timedelta(days=30), 99, "view")]]


def batch_sessions(spark, rows, gap="5 minutes"):
    df = spark.createDataFrame(rows, EVENTS)
    x = operators.sessions(df, "user_id", "ts", gap).alias("s")
    both = x.join(df.alias("e"), F.expr("s.user_id = e.user_id AND e.ts BETWEEN session_start AND session_end"))
    out = both.groupBy("s.user_id", "session_start", "session_end").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("n_views"), F.count_if(F.col("event_type") == "purchase").alias("n_purchases"))
    return sorted(tuple(r) for r in out.collect())


def run_sessions(spark, events, tmp_path):
    out = streaming.closed_sessions(events, 300, "10 minutes").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_sessions_by_timers_are_the_batch_answer(spark, tmp_path):
    streaming.with_rocksdb(spark)
    rows, batches = shuffled(1)
    got = run_sessions(spark, files(spark, str(tmp_path / "in"), batches), tmp_path)
    want = batch_sessions(spark, rows)
    assert got == want and len(want) > 30


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    streaming.with_rocksdb(spark)
    rows, batches = shuffled(2)
    first = run_sessions(spark, files(spark, str(tmp_path / "in"), batches[:2]), tmp_path)
    assert first and len(first) < len(batch_sessions(spark, rows))  # some are open
    got = run_sessions(spark, files(spark, str(tmp_path / "in"), batches[2:]), tmp_path)
    assert got == batch_sessions(spark, rows)


def test_late_rows_change_nothing(spark, tmp_path):
    streaming.with_rocksdb(spark)
    rows, batches = shuffled(3, 200)
    late = [(5000 + k, START + timedelta(minutes=k), 2, "purchase") for k in range(5)] + [(6000, None, 2, "view"), (6001, START, None, "view"), (None, START, 1, "view")]
    after = [(10**6 + 1, START + timedelta(days=60), 99, "view")]
    got = run_sessions(spark, files(spark, str(tmp_path / "in"), [*batches, late, after]), tmp_path)
    assert got == sorted([*batch_sessions(spark, rows), (99, START + timedelta(days=30), START + timedelta(days=30), 1, 1, 0)])


@pytest.mark.parametrize("slide", [None, "20 minutes"])
def test_windows_leave_out_late_rows(spark, tmp_path, slide):
    rows, batches = shuffled(4, 200)
    distinct = [[r for k, r in enumerate(b) if r not in b[:k]] for b in batches]
    late = [(7000, START, 1, "view")]
    events = files(spark, str(tmp_path / "in"), [*distinct, late])
    got = streaming.drain(spark, streaming.tumbling(events, slide=slide), "windows" + str(slide is None), str(tmp_path / "c"))
    df = spark.createDataFrame([r for b in distinct for r in b], EVENTS)
    w = F.window(F.col("ts").cast("timestamp"), "1 hour", slide) if slide else F.window(F.col("ts").cast("timestamp"), "1 hour")
    want = df.where("user_id < 99").groupBy(w, "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_session_windows_and_repeated_rows(spark, tmp_path):
    """session_window over deduplicated rows gives the same sessions as the timers."""
    rows, batches = shuffled(5, 200)
    events = files(spark, str(tmp_path / "in"), batches)
    out = streaming.timed(events, "10 minutes").dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.session_window("ts", "5 minutes"), "user_id").agg(F.count("*").alias("n"))
    got = streaming.drain(spark, out.select("user_id", F.col("session_window.start").cast("timestamp_ntz"), "n"), "session_windows", str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == [(u, s, n) for u, s, _, n, _, _ in batch_sessions(spark, rows)]


def test_contents_of_a_table_stream(spark, data, tmp_path):
    from quarry.sources import stream

    df = stream(spark, data, "events")
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = table(spark, data, "events")
    got = spark.read.schema(want.schema).parquet(str(tmp_path / "out"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_a_replayed_batch_leaves_no_repeats(spark, tmp_path):
    """The third batch fails after its rows are written, before the checkpoint knows; the restart runs it again."""
    rows, batches = shuffled(6, 200)
    folder, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    events = files(spark, folder, batches)
    seen = []

    def fails(batch):
        seen.append(1)
        if len(seen) == 3:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id=2")  # as if all were written, then the driver lost
            raise RuntimeError("lost")
        return batch

    with pytest.raises(Exception, match="lost"):
        streaming.write_once(events, path, checkpoint, fails).awaitTermination()
    streaming.write_once(events, path, checkpoint).awaitTermination()
    got = streaming.committed(spark, path, events.schema)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r[0] for b in batches for r in b)
    assert got.select("batch_id").distinct().count() == len(batches)
    # A batch without its _SUCCESS isn't read.
    (tmp_path / "out" / "batch_id=1" / "_SUCCESS").unlink()
    assert streaming.committed(spark, path, events.schema).select("batch_id").distinct().count() == len(batches) - 1
    assert streaming.committed(spark, str(tmp_path / "nothing"), events.schema).count() == 0


class Calls:
    """A handle that keeps a key's state in memory and counts what is asked of it."""

    def __init__(self):
        self.n, self.timers, self.held = 0, set(), {}

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            if name in ("getValueState", "getMapState"):
                return self
            if name == "registerTimer":
                self.timers.add(args[0])
            if name == "deleteTimer":
                self.timers.discard(args[0])
            if name == "update":
                self.held["v"] = args[0]
            if name == "clear":
                self.held.clear()
            if name == "updateValue":
                self.held[args[0]] = args[1]
            if name == "removeKey":
                self.held.pop(args[0])
            return {"get": self.held.get("v"), "listTimers": iter(sorted(self.timers)), "iterator": iter(list(self.held.items()))}.get(name)

        return call

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_a_key_asks_little_of_its_state(spark):
    """A batch of 2,000 sessions of a key is a handful of calls and one timer, not some for each event; timers close what is over."""
    import pandas as pd

    from quarry.streaming.state import OpenSessions

    state, minute = Calls(), 60_000_000
    state.now = 0
    sessions_ = OpenSessions(30 * minute)
    sessions_.init(state)
    at = [k // 2 * 100 * minute + k % 2 * minute for k in range(4000)]
    rows = pd.DataFrame({"event_id": range(4000), "at": at, "event_type": ["view", "purchase"] * 2000})
    assert all(p.empty for p in sessions_.handleInputRows((7,), iter([rows.sample(frac=1, random_state=1), rows[:10]]), state))
    assert state.n < 10 and state.timers == {31 * minute // 1000}
    state.now, fired = 250 * minute // 1000, state.timers.pop()
    (got,) = sessions_.handleExpiredTimer((7,), state, fired)
    assert list(got.itertuples(index=False, name=None)) == [(7, k * 100 * minute, (k * 100 + 1) * minute, 2, 1, 1) for k in range(3)]
    assert state.timers == {331 * minute // 1000} and state.n < 20
    extra = pd.DataFrame({"event_id": [9000, 9001], "at": [260 * minute, 3], "event_type": ["click", "view"]})  # an earlier session, and one too late
    list(sessions_.handleInputRows((7,), iter([extra]), state))
    assert state.timers == {290 * minute // 1000}
    state.now = 10**11
    (got,) = sessions_.handleExpiredTimer((7,), state, state.timers.pop())
    assert len(got) == 1998 and got["n"].sum() == 4000 - 6 + 1 and not state.held and not state.timers
