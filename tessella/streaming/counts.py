"""Counts of arriving annotations per image and window; beyond what the batch operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, every: str = "1 hour", late: str = "2 hours", time: str = "ts", key: str = "event_type") -> DataFrame:
    """(start, key, n): closed windows only, rows later than `late` are left out."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), key, "n")
