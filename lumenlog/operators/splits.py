"""Chronological windows in whole days, counted from the midnight of the first row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_windows(rows: DataFrame, keys: list[str], windows: DataFrame, whole: bool = False) -> DataFrame:
    """keys, role, start, end: the instants of windows of days (role, first_day, last_day; day 1 is the first), each up to the key's last end at most.

    Windows have to be in order and apart, with days from 1 on; one that is not fails the job. `whole`: every window but the first is all of the data, as splits were before they were held out.
    rows: keys, start_time, end_time. A window that begins behind a key's last end is empty: its end is its start.
    """
    before = F.max("last_day").over(Window.orderBy("first_day", "last_day", "role").rowsBetween(Window.unboundedPreceding, -1))  # a row a window
    fault = F.when(F.col("first_day").isNull() | F.col("last_day").isNull() | (F.col("first_day") < 1), "days have to be 1 or more").when(F.col("first_day") > F.col("last_day"), "a window ends before it begins").when(F.lit(not whole) & (before >= F.col("first_day")), "windows have to be in order and apart")
    first = F.min("first_day").over(Window.partitionBy(F.lit(1)))
    checked = windows.select("role", "first_day", "last_day", fault.alias("_fault"), (F.col("first_day") == first).alias("_learning"))
    checked = checked.withColumn("first_day", F.when(F.col("_fault").isNull(), F.col("first_day")).otherwise(F.raise_error(F.concat(F.col("_fault"), F.lit(": "), F.coalesce("role", F.lit("null")))).cast("int")))
    span = rows.groupBy(*keys).agg(F.date_trunc("day", F.min("start_time")).cast("timestamp_ntz").alias("_a"), F.max("end_time").alias("_b"))
    day = lambda c: F.timestamp_add("DAY", F.col(c), F.col("_a"))
    every = F.lit(whole) & ~F.col("_learning")
    start = F.when(every, F.col("_a")).otherwise(day("_from"))
    end = F.when(every, F.col("_b")).when(F.col("_learning") & F.lit(whole), day("last_day")).otherwise(F.least(day("last_day"), F.col("_b")))
    at = span.join(F.broadcast(checked)).withColumn("_from", F.col("first_day") - 1)  # a row a window
    return at.select(*keys, "role", start.alias("start"), F.greatest(start, end).alias("end"))


def in_windows(rows: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of intervals inside each window of their key, with its role; an interval over a border is in both, cut there."""
    both = rows.join(windows.withColumnsRenamed({"start": "_w0", "end": "_w1"}), keys).filter("end_time > _w0 AND start_time < _w1")
    cut = both.withColumns({"start_time": F.greatest("start_time", "_w0"), "end_time": F.least("end_time", "_w1")}).drop("_w0", "_w1")
    return cut.filter("end_time > start_time")
