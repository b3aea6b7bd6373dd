from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry import streaming
from quarry.sources import stream, table


@pytest.fixture
def feed(spark, data, tmp_path):
    """The events in four files, in order of time."""
    df = table(spark, data, "events")
    for k in range(4):
        df.where(f"event_id div 2500 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k in range(4):
        next((tmp_path / "in" / str(k)).glob("*.parquet")).rename(flat / f"events{k}.parquet")
    schema = df.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events*.parquet").parquet(str(flat)), df


def test_tumbling_is_the_batch_result_up_to_the_watermark(spark, feed, tmp_path):
    events, df = feed
    got = streaming.drain(spark, streaming.tumbling(events), "tumbling", str(tmp_path / "c"))
    batch = df.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")
    assert got.count() > 0 and got.exceptAll(batch).count() == 0
    assert batch.exceptAll(got).groupBy("start").count().count() <= 3  # windows still open


def test_deduplication(spark, feed, tmp_path):
    events, df = feed
    got = streaming.drain(spark, streaming.deduplicated(events, ["event_id"]), "dedup", str(tmp_path / "c"))
    assert got.count() == df.count()


def test_stream_stream_join(spark, feed, tmp_path):
    events, df = feed
    got = streaming.drain(spark, streaming.followed(events, "view", "purchase"), "followed", str(tmp_path / "c"))
    a, b = df.where("event_type = 'view'").alias("a"), df.where("event_type = 'purchase'").alias("b")
    want = a.join(b, F.expr("a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + interval 1 hour"))
    assert got.count() == want.count()


def test_table_as_a_stream(spark, data):
    assert stream(spark, data, "events").isStreaming
