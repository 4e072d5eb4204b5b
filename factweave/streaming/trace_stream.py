"""The trace roll-ups over a stream of events, with event time and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_hits(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Hits by user and event type in windows of event time; events later than the watermark are dropped by Spark."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    hits = F.get_json_object("props", "$.k").try_cast("bigint")
    return stamped.groupBy(F.window("at", window), "user_id", "event_type").agg(F.sum(hits).alias("hits"), F.count("*").alias("events"))


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once, with state no older than the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
