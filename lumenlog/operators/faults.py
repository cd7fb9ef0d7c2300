"""Sensor faults put into a log, and invariants that a log has to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chance(seed: int, what: str, *keys: str) -> Column:
    """A number between 0 and 1 that depends on the row's keys only, so that results don't depend on partitions."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(what), *(F.col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def inject(events: DataFrame, seed: int, drop: float, flip: float, delay: float, delay_us: int, duplicate: float) -> DataFrame:
    """events (id, ts, sensor, bit) with drops, flips, delays and duplicates one microsecond later; `fault` names what happened.

    Each row decides for itself by a hash of seed and id; there is no shuffle.
    """
    c = {x: _chance(seed, x, "id") for x in ("drop", "flip", "delay", "duplicate")}
    kept = events.filter(c["drop"] >= drop)
    flipped, delayed = c["flip"] < flip, c["delay"] < delay
    ts = F.when(delayed, F.timestamp_add("MICROSECOND", F.lit(delay_us), F.col("ts"))).otherwise(F.col("ts"))
    bit = F.when(flipped, 1 - F.col("bit")).otherwise(F.col("bit")).cast("int")
    fault = F.concat_ws("+", F.when(flipped, F.lit("flip")), F.when(delayed, F.lit("delay")))
    first = F.struct(ts.alias("ts"), bit.alias("bit"), fault.alias("fault"))
    second = F.struct(F.timestamp_add("MICROSECOND", F.lit(1), ts).alias("ts"), bit.alias("bit"), F.concat_ws("+", F.when(fault != "", fault), F.lit("duplicate")).alias("fault"))
    rows = F.when(c["duplicate"] < duplicate, F.array(first, second)).otherwise(F.array(first))
    return kept.select("id", "sensor", F.explode(rows).alias("x")).select("id", "sensor", "x.*")


def repeats(events: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Rows that say what their device said last."""
    w = Window.partitionBy(*keys).orderBy("ts", "ord")
    return events.withColumn("_p", F.lag(state).over(w)).filter(F.col("_p") == F.col(state)).drop("_p")


def without_repeats(events: DataFrame, keys: list[str], state: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts", "ord")
    return events.withColumn("_p", F.lag(state).over(w)).filter(~F.col("_p").eqNullSafe(F.col(state))).drop("_p")


def violations(events: DataFrame, keys: list[str], known: list[str]) -> DataFrame:
    """keys, n_rows and how often each invariant is broken: empty cells, unknown sensors, time that runs back in file order, repeated (ts, sensor, bit)."""
    w = Window.partitionBy(*keys).orderBy("ord")
    same = Window.partitionBy(*keys, "ts", "sensor", "bit").orderBy("ord")
    rows = events.withColumn("_back", F.lag("ts").over(w) > F.col("ts")).withColumn("_again", F.row_number().over(same) > 1)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("ts").isNull() | F.col("sensor").isNull() | F.col("bit").isNull()).alias("empty_cells"),
        F.count_if(~F.col("sensor").isin(known)).alias("unknown_sensors"),
        F.count_if("_back").alias("time_back"),
        F.count_if("_again").alias("duplicates"),
    )
