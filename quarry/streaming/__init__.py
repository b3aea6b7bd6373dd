"""Event-time queries over streams, state with timers, and a sink that a replayed batch doesn't repeat."""

from quarry.streaming.sink import committed, write_once
from quarry.streaming.state import closed_sessions, with_rocksdb
from quarry.streaming.windows import deduplicated, drain, followed, sessions, timed, tumbling

__all__ = ["closed_sessions", "committed", "deduplicated", "drain", "followed", "sessions", "timed", "tumbling", "with_rocksdb", "write_once"]
