"""Streaming ingest: an extension of the batch knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a window and type; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark: idempotent ingest."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
