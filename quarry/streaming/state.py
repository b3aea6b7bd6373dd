"""Sessions as state with timers: what each key has open lives in RocksDB, and a timer in event time closes it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.streaming.windows import timed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times go in and out of Python as microseconds since 1970, whatever the session's zone.
SCHEMA = "user_id long, session_start long, session_end long, n long, n_views long, n_purchases long"
COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]
#: An open event as it lies in the state.
EVENT = np.dtype([("at", "<i8"), ("id", "<i8"), ("view", "?"), ("bought", "?")])


class OpenSessions(StatefulProcessor):
    """Keeps a key's events until its session can't grow any more, then emits the session.

    An event that arrives out of order joins the session that it belongs to, and may join two to one; an event seen before (same id) changes nothing; one older than the watermark is
    too late and left out. A session ends where ``gap`` passes without an event; the watermark then rules out more.
    State is the events of open sessions alone, packed in one value: a key's batch reads and writes it once, however many its events. A key has one timer, at the moment that its
    first open session can close; when it fires, all sessions that are over are closed at once, and the next gets the timer.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "events binary, timer long")

    def load(self) -> tuple[np.ndarray, int | None]:
        """Open events in order of time, and the timer that is set."""
        held = self.open.get()
        return (np.frombuffer(held[0], EVENT), held[1]) if held else (np.empty(0, EVENT), None)

    def starts(self, events: np.ndarray) -> np.ndarray:
        """Places of the sessions' first events, and the number of events."""
        return np.r_[0, np.flatnonzero(np.diff(events["at"]) >= self.gap) + 1, len(events)] if len(events) else np.zeros(1, np.int64)

    def store(self, events: np.ndarray, starts: np.ndarray, timer: int | None) -> None:
        """The state of the key, with a timer no later than its first session's end."""
        if not len(events):
            self.open.clear()
            return
        closes = -(-(int(events["at"][starts[1] - 1]) + self.gap) // 1000)
        if timer is None or timer > closes:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(closes)
            timer = closes
        self.open.update((events.tobytes(), timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        known, timer = self.load()
        parts = [known]
        for part in rows:
            new = np.empty(len(part), EVENT)
            new["at"], new["id"], kind = part["at"].to_numpy(), part["event_id"].to_numpy(), part["event_type"].to_numpy()
            new["view"], new["bought"] = kind == "view", kind == "purchase"
            parts.append(new[new["at"] >= late])
        events = np.concatenate(parts)
        if len(events) > len(known):
            events = events[len(events) - 1 - np.unique(events["id"][::-1], return_index=True)[1]]  # of one id the last
            events = events[np.lexsort((events["id"], events["at"]))]
            self.store(events, self.starts(events), timer)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events, _ = self.load()
        starts = self.starts(events)
        over = int(np.searchsorted(events["at"][starts[1:] - 1] + self.gap, now, "right")) if len(events) else 0
        first, last = starts[:over], starts[1 : over + 1]
        self.store(events[starts[over] :], starts[over:] - starts[over], None)  # the timer that fired is gone
        if not over:
            yield pd.DataFrame()
            return
        done = events[: starts[over]]
        counts = (np.add.reduceat(done[c].astype(np.int64), first) for c in ("view", "bought"))
        yield pd.DataFrame(dict(zip(COLUMNS, (np.full(over, key[0]), done["at"][first], done["at"][last - 1], last - first, *counts), strict=True)))

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, gap_seconds: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """Sessions that are over: user_id, session_start, session_end, n and the numbers of views and purchases. events: event_id, ts, user_id, event_type.

    Rows without a user, a time or an id are left out. The state store has to be RocksDB (``ROCKSDB``).
    """
    there = events.where("event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL").select("event_id", "ts", "user_id", F.coalesce("event_type", F.lit("")).alias("event_type"))
    rows = timed(there, delay).withColumn("at", F.unix_micros("ts"))
    out = rows.groupBy("user_id").transformWithStateInPandas(OpenSessions(gap_seconds * 1_000_000), SCHEMA, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("session_start", "session_end")})


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The session with state in RocksDB, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark
