"""Windows, deduplication and joins in event time. Each returns a streaming DataFrame in append mode; ``drain`` runs one to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def timed(events: DataFrame, delay: str) -> DataFrame:
    """A watermark needs a time with zone: the column is cast under the session's UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed(events, delay).groupBy(w, "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return timed(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    return timed(events, delay).dropDuplicatesWithinWatermark(keys)


def followed(events: DataFrame, first: str, then: str, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Pairs of a user's events, the second within so long of the first: a stream-stream join with bounded state."""
    a = timed(events.where(F.col("event_type") == first), delay).select(F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("event_id").alias("first_id"))
    b = timed(events.where(F.col("event_type") == then), delay).select("user_id", "ts", F.col("event_id").alias("then_id"))
    return a.join(b, F.expr(f"user = user_id AND ts >= at AND ts <= at + interval {within}")).select("user_id", "first_id", "then_id")


def drain(spark: SparkSession, df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All rows that are final once the source has no more, from a memory sink (for tests)."""
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
