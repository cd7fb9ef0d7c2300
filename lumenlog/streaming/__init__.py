"""Structured Streaming forms of some operators; what a log engine needs beyond files.

Late rows are bounded by a watermark, so state is dropped when a window can no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """keys, start, end, n, n_on of tumbling windows over a stream with columns ts (with zone), bit and keys."""
    w = F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("n_on"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "n_on")


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """keys, start, end, n of sessions: rows of a key with no gap longer than `gap`."""
    out = events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows of a stream without those that repeat a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
