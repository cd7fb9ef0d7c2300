"""Sensor vectors as bit masks: hold, smooth, compress, representative states, nearest states, grid-free intervals.

Sensors have fixed places in a mask of 63 bits, so a vector is one long and comparing two is one instruction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import OTHER, hamming, micros
from lumenlog.operators import blocks, sequences


def _at(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def bit_of(sensor: Column | str, sensors: list[str]) -> Column:
    """The sensor's bit; null for sensors that have none."""
    s, out = F.col(sensor) if isinstance(sensor, str) else sensor, None
    for i, name in enumerate(sensors):
        out = F.when(s == name, F.lit(1 << i)) if out is None else out.when(s == name, F.lit(1 << i))
    return out.cast("long")


def _mask(values: list[Column]) -> Column:
    """The mask of sensors' values; null is 0."""
    return sum((F.coalesce(v, F.lit(0)).cast("long") * F.lit(1 << i) for i, v in enumerate(values)), F.lit(0).cast("long"))


def event_vectors(events: DataFrame, keys: list[str], sensors: list[str], block: Column | None = None) -> DataFrame:
    """keys, ts, ord, mask after each event of a known sensor and value; every sensor starts at 0.

    events: keys, ts, ord, sensor, bit. Each sensor's last value so far, in one window a home, or in one for each `block` of a home (see `blocks`).
    """
    known = events.filter(F.col("sensor").isin(sensors) & F.col("bit").isNotNull())
    values = [F.when(F.col("sensor") == s, F.col("bit").cast("long")) for s in sensors]
    if block is None:
        w = Window.partitionBy(*keys).orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, 0)
        return known.select(*keys, "ts", "ord", _mask([F.last(v, ignorenulls=True).over(w) for v in values]).alias("mask"))
    held = blocks.folded(known, keys, block, ("ts", "ord"), {f"_h{i}": ("last", v) for i, v in enumerate(values)})
    return held.select(*keys, "ts", "ord", _mask([F.col(f"_h{i}") for i in range(len(sensors))]).alias("mask"))


def sample_and_hold(events: DataFrame, keys: list[str], sensors: list[str], start: str, step_seconds: int, n: int, block_points: int | None = None) -> DataFrame:
    """keys, ts, mask on a grid of n points: an event counts from the first point at or after it; events before the grid count at its first point.

    The grid is one range of rows for each home; last values fill forward in one window a home, or in one for every `block_points` points of it.
    """
    t0, step = micros(F.lit(start).cast("timestamp_ntz")), step_seconds * 1_000_000
    slot = F.greatest(F.lit(0).cast("long"), F.ceil((micros("ts") - t0) / F.lit(step)).cast("long"))
    held = events.filter(F.col("sensor").isin(sensors) & F.col("bit").isNotNull()).withColumn("slot", slot).filter(F.col("slot") < n)
    last = held.groupBy(*keys, "slot", "sensor").agg(F.max_by("bit", F.struct("ts", "ord")).alias("bit"))
    values = [F.max(F.when(F.col("sensor") == s, F.col("bit"))).alias(f"_v{i}") for i, s in enumerate(sensors)]
    at_slot = last.groupBy(*keys, "slot").agg(*values)
    homes = events.select(*keys).distinct()
    if block_points is None:
        grid = homes.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("slot"))
        w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        filled = grid.join(at_slot, [*keys, "slot"], "left")
        mask = _mask([F.last(f"_v{i}", ignorenulls=True).over(w) for i in range(len(sensors))])
    else:
        # blocks of a home first, points when blocks are spread, so that no task writes a home's whole grid
        firsts = homes.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.lit(block_points).cast("long"))).alias("_first")).repartition(*keys, "_first")
        grid = firsts.select(*keys, F.explode(F.sequence("_first", F.least(F.col("_first") + (block_points - 1), F.lit(n - 1)))).alias("slot"))
        held = blocks.folded(grid.join(at_slot, [*keys, "slot"], "left"), keys, F.floor(F.col("slot") / F.lit(block_points)), ("slot",), {f"_h{i}": ("last", F.col(f"_v{i}")) for i in range(len(sensors))})
        filled, mask = held, _mask([F.col(f"_h{i}") for i in range(len(sensors))])
    return filled.select(*keys, _at(t0 + F.col("slot") * step).alias("ts"), mask.alias("mask"))


def delayed_off(vectors: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """A bit stays on for rows - 1 further rows: a moving or over the current row and those before it."""
    if rows <= 0:
        return vectors
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-(rows - 1), 0)
    return vectors.withColumn("mask", F.bit_or("mask").over(w))


def compressed(vectors: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts",), block: Column | None = None) -> DataFrame:
    """The first row of every run of one mask."""
    if block is None:
        marked = vectors.withColumn("_p", F.lag("mask").over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        marked = blocks.neighbours(vectors, keys, block, order, before={"_p": F.col("mask")})
    return marked.filter(F.col("_p").isNull() | (F.col("_p") != F.col("mask"))).drop("_p")


def representative_states(vectors: DataFrame, k: int, order: tuple[str, ...]) -> DataFrame:
    """rank, state_id, mask, cnt: the k most frequent masks of compressed vectors; ties go to the mask that came first. k rows at most."""
    counted = vectors.groupBy("mask").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct(*order)).alias("_f"))
    top = counted.orderBy(F.desc("cnt"), "_f").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("cnt"), "_f")).alias("rank"), "mask", "cnt").withColumn("state_id", F.concat(F.lit("S"), F.col("rank")))


def nearest_states(vectors: DataFrame, states: DataFrame, h: int, other: str = OTHER) -> DataFrame:
    """Adds `state`: the mask's own state, else the nearest within h bits (ties: the lower rank), else `other`.

    Distinct masks meet the states (at most 2**sensors and k rows), and rows get their state by an equi-join.
    """
    masks = vectors.select("mask").distinct()
    near = masks.join(F.broadcast(states.select("rank", "state_id", F.col("mask").alias("_m"))), hamming("mask", "_m") <= h)
    best = near.groupBy("mask").agg(F.min_by("state_id", F.struct(hamming("mask", "_m"), F.col("rank"))).alias("_state"))
    return vectors.join(best, "mask", "left").withColumn("state", F.coalesce("_state", F.lit(other))).drop("_state")


def on_intervals(events: DataFrame, keys: list[str], period_end: Column, extend_seconds: int = 0) -> DataFrame:
    """keys, sensor, start_us, end_us: when each sensor was on, from the last value of each whole second on; touching intervals are one."""
    second = F.ceil(micros("ts") / F.lit(1_000_000)).cast("long") * 1_000_000
    last = events.filter(F.col("bit").isNotNull()).withColumn("us", second).groupBy(*keys, "sensor", "us").agg(F.max_by("bit", F.struct("ts", "ord")).alias("bit"))
    w = Window.partitionBy(*keys, "sensor").orderBy("us")
    changes = last.withColumn("_p", F.lag("bit").over(w)).filter((F.col("bit") != F.col("_p")) | F.col("_p").isNull() & (F.col("bit") == 1))
    stop = F.least(F.coalesce(F.lead("us").over(w) + F.lit(extend_seconds * 1_000_000), period_end), period_end)
    held = changes.withColumn("end_us", stop).filter("bit = 1 AND end_us > us").withColumnRenamed("us", "start_us")
    return merged(held.select(*keys, "sensor", "start_us", "end_us"), [*keys, "sensor"], "start_us", "end_us")


def merged(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching spans of a key as one: a running max of ends marks where a new one begins."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def network_intervals(events: DataFrame, keys: list[str], sensors: list[str], days: int, window_seconds: int) -> DataFrame:
    """keys, start_time, end_time, mask over whole days from the first midnight: the state of all sensors between any two changes.

    An off is delayed by window_seconds - 1. Only changes are rows; no grid is made.
    """
    day = F.min(F.date_trunc("day", F.col("ts"))).cast("timestamp_ntz")
    first = events.groupBy(*keys).agg(day.alias("_day"))
    bounded = events.join(first, keys).withColumn("_t0", micros("_day")).withColumn("_t1", F.col("_t0") + F.lit(days * 86_400_000_000))
    inside = bounded.filter(micros("ts") < F.col("_t1"))
    per_key = [*keys, "_t0", "_t1"]
    on = on_intervals(inside, per_key, F.col("_t1"), max(0, window_seconds - 1))
    bit = bit_of("sensor", sensors)
    ups = on.select(*per_key, F.col("start_us").alias("us"), bit.alias("d"))
    downs = on.select(*per_key, F.col("end_us").alias("us"), (-bit).alias("d"))
    edges = first.select(*keys, micros("_day").alias("_t0")).withColumn("_t1", F.col("_t0") + F.lit(days * 86_400_000_000))
    base = edges.select(*per_key, F.col("_t0").alias("us"), F.lit(0).cast("long").alias("d"))
    change = ups.unionAll(downs).unionAll(base).groupBy(*per_key, "us").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("us")
    masks = change.withColumn("mask", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("us < _t1")
    kept = masks.withColumn("_p", F.lag("mask").over(w)).filter("_p IS NULL OR _p <> mask")
    return kept.select(*keys, _at(F.col("us")).alias("start_time"), _at(F.coalesce(F.lead("us").over(w), F.col("_t1"))).alias("end_time"), "mask")


def state_sequence(events: DataFrame, keys: list[str], sensors: list[str], states: DataFrame, h: int | None = None, other: str = OTHER, compress: bool = True, block: Column | None = None) -> DataFrame:
    """keys, ts, ord, state after each event: its mask's own state, or with `h` the nearest within h bits, else `other`; `compress`: only where the state changes."""
    held = nearest_states(event_vectors(events, keys, sensors, block), states, h or 0, other).select(*keys, "ts", "ord", "state")
    return sequences.runs(held, keys, block) if compress else held
