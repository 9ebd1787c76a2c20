"""Screening feeds as streams: late and repeated items, and counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_items(items: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Each key once within the watermark; an item that comes later than that is dropped with its state."""
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sends_per_window(events: DataFrame, who: str, time: str, window: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """How many events each sender has in every window, which is final once the watermark has passed."""
    w = F.window(F.col(time), window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), who).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), who, "n")
