"""Statistics of event logs, distributions and networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import safe_divide, seconds_between
from lumenlog.operators import blocks
from lumenlog.operators.percentiles import joined, percentiles


def daily_variation(events: DataFrame, by: list[str]) -> DataFrame:
    """Days with events, mean a day, and population deviation over mean."""
    days = events.groupBy(*by, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy(*by).agg(F.count(F.lit(1)).alias("n_days"), F.sum("n").alias("n_events"), F.avg("n").alias("mean_per_day"), safe_divide(F.stddev_pop("n"), F.avg("n")).alias("daily_cv"))


def hour_histogram(events: DataFrame, by: list[str]) -> DataFrame:
    """Events of each hour and their share."""
    n = events.groupBy(*by, F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def gaps(events: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Seconds between a key's events: count, mean, median, 90th percentile."""
    w = Window.partitionBy(*keys).orderBy("ts", "ord")
    g = events.withColumn("gap", seconds_between(F.lag("ts").over(w), "ts")).filter(F.col("gap").isNotNull())
    out = g.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gaps"), F.avg("gap").alias("mean_gap"))
    return joined(out, percentiles(g, by, "gap", {"median_gap": 0.5, "p90_gap": 0.9}), by)


def activations(events: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """From a sensor's 0-to-1 change to its next 0: count, mean and median seconds; and seconds from off to the next on."""
    w = Window.partitionBy(*keys).orderBy("ts", "ord")
    changed = events.withColumn("_p", F.lag("bit").over(w)).filter((F.col("_p").isNull() & (F.col("bit") == 1)) | (F.col("_p") != F.col("bit")))
    held = changed.withColumn("_next", F.lead("ts").over(w)).filter(F.col("_next").isNotNull()).withColumn("s", seconds_between("ts", "_next"))
    on, off = F.when(F.col("bit") == 1, F.col("s")), F.when(F.col("bit") == 0, F.col("s"))
    out = held.groupBy(*by).agg(F.count(on).alias("n_on"), F.avg(on).alias("mean_on"), F.count(off).alias("n_off"))
    out = joined(out, percentiles(held, by, on, {"median_on": 0.5}), by)
    return joined(out, percentiles(held, by, off, {"median_off": 0.5}), by).select(*by, "n_on", "mean_on", "median_on", "n_off", "median_off")


def divergence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Jensen-Shannon divergence (base 2) and distance of the cumulated shares, of two histograms key, n over the union of their keys."""
    both = a.select(F.col(key), F.col("n").alias("na")).join(b.select(F.col(key), F.col("n").alias("nb")), key, "full").fillna(0, ["na", "nb"])
    whole = Window.partitionBy(F.lit(1))  # one row for each key of a histogram: hours, sensors, states
    p = both.withColumn("p", F.col("na") / F.sum("na").over(whole)).withColumn("q", F.col("nb") / F.sum("nb").over(whole)).withColumn("m", (F.col("p") + F.col("q")) / 2)
    upto = Window.partitionBy(F.lit(1)).orderBy(key)
    p = p.withColumn("_d", F.abs(F.sum("p").over(upto) - F.sum("q").over(upto)))
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0)
    return p.agg((F.sum(part("p")) / 2 + F.sum(part("q")) / 2).alias("js"), F.sum("_d").alias("cdf_distance"), F.count(F.lit(1)).alias("n_keys"))


def quantile_distance(a: DataFrame, b: DataFrame, column: str, points: int = 256) -> DataFrame:
    """Mean distance of two samples' quantiles at evenly spaced points (interpolated)."""
    at = [(i + 0.5) / points for i in range(points)]
    qa, qb = percentiles(a, [], column, {"qa": at}), percentiles(b, [], column, {"qb": at})
    pairs = qa.join(F.broadcast(qb)).select(F.explode(F.arrays_zip("qa", "qb")).alias("x"))  # one row each
    return pairs.agg(F.avg(F.abs(F.col("x.qa") - F.col("x.qb"))).alias("distance"))


def ranked_distance(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Of two counts by key (sensors, states), most frequent first: the mean distance of the shares at equal ranks, and at how many ranks both have the same key.

    Ties are in order of the key; where one side has fewer keys, its share is 0.
    """
    by = Window.partitionBy(F.lit(1))  # one row for each key of a histogram
    side = lambda x, name: x.select(F.row_number().over(by.orderBy(F.desc("n"), key)).alias("rank"), F.col(key).alias(f"_k{name}"), (F.col("n") / F.sum("n").over(by)).alias(f"_s{name}"))
    both = side(a, "a").join(side(b, "b"), "rank", "full")
    gap = F.abs(F.coalesce("_sa", F.lit(0.0)) - F.coalesce("_sb", F.lit(0.0)))
    return both.agg(F.count(F.lit(1)).alias("n_ranks"), F.avg(gap).alias("mean_distance"), F.sum(gap).alias("distance"), F.count_if(F.col("_ka") == F.col("_kb")).alias("same_key"))


def network_summary(edges: DataFrame, by: list[str]) -> DataFrame:
    """States, edges, density, share of edges whose reverse exists, mean entropy of what leaves a state."""
    states = edges.select(*by, F.explode(F.array("src", "dst")).alias("s")).groupBy(*by).agg(F.count_distinct("s").alias("n_states"))
    back = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("_back"))
    flagged = edges.join(back, [*by, "src", "dst"], "left")
    e = flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n_edges"), F.count("_back").alias("reversible"))
    h = edges.groupBy(*by, "src").agg((-F.sum(F.col("prob") * F.log2("prob"))).alias("h")).groupBy(*by).agg(F.avg("h").alias("mean_entropy"))
    n = F.col("n_states")
    return states.join(e, by).join(h, by).select(*by, "n_states", "n_edges", safe_divide(F.col("n_edges"), n * (n - 1)).alias("density"), safe_divide(F.col("reversible"), F.col("n_edges")).alias("reversible_ratio"), "mean_entropy")


def profile(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows, distinct values and runs of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    return new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(value).alias("n_values"), F.sum("_new").alias("n_runs"))


def usage_totals(calls: DataFrame, by: list[str], expected: int) -> DataFrame:
    """Token totals of runs, complete where all calls are there and no field is missing."""
    ok = F.count_if(F.col("input_tokens").isNull() | F.col("output_tokens").isNull()) == 0
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), (ok & (F.count(F.lit(1)) == expected)).cast("int").alias("complete"))


def occupancy(rows: DataFrame, keys: list[str], by: list[str], column: str, block: Column | None = None) -> DataFrame:
    """by, name, hours, share: how long each name of a map column was held, times the length of its list; a row's map holds until the key's next row, the last one's not at all.

    rows: keys, ts, ord, column (map of names to lists). Share: of all hours of a `by`.
    """
    if block is None:
        ahead = rows.withColumn("_next", F.lead("ts").over(Window.partitionBy(*keys).orderBy("ts", "ord")))
    else:
        ahead = blocks.neighbours(rows, keys, block, ("ts", "ord"), after={"_next": F.col("ts")})
    held = ahead.filter(F.col("_next").isNotNull()).withColumn("_s", F.greatest(F.lit(0.0), seconds_between("ts", "_next")))
    each = held.select(*by, "_s", F.explode(column).alias("name", "_who"))
    sums = each.groupBy(*by, "name").agg((F.sum(F.col("_s") * F.size("_who")) / 3600).alias("hours"))
    return sums.withColumn("share", safe_divide(F.col("hours"), F.sum("hours").over(Window.partitionBy(*(by or [F.lit(1)])))))  # a row a name


def wide(rows: DataFrame, by: list[str], column: str, values: list, value: Column) -> DataFrame:
    """by, and a column for each of the given values of `column` with the aggregate `value`; they are given, so no job has to find them first."""
    return rows.groupBy(*by).pivot(column, values).agg(value)
