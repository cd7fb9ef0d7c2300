"""Queries of the operators that take very long keys, hot groups and many patterns. In the log of `uneven` one home has half of all events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog import sources
from lumenlog.functions import OTHER
from lumenlog.operators import intervals, sequences, sinks, splits, stats, vectors
from lumenlog.operators.blocks import daily
from lumenlog.operators.shared import folder, stored
from lumenlog.plans.adapter import EV, INTERVAL_TABLES, SENSORS, SPLIT, log, truths
from lumenlog.plans.queries import _IV, _MASKS, _TOP, ORACLE, _round, _span_grams, _states, query


def uneven(spark, sf) -> DataFrame:
    """The log with every second event in home 0."""
    return log(spark, sf).withColumn("home", F.when(F.col("ord") % 2 == 0, 0).otherwise(F.col("home")))


def _uneven(sql: str) -> str:
    """The same query over the uneven log."""
    assert "user_id AS home" in sql
    return sql.replace("user_id AS home", "CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS home")


@query(_uneven(ORACLE["state_runs"]))
def long_runs(spark, sf):
    """Runs of homes that are cut by date."""
    return sequences.runs(uneven(spark, sf), ["home"], daily()).select("home", "ts", "ord", "state")


@query(_uneven(ORACLE["transition_network"]))
def long_transitions(spark, sf):
    return _round(sequences.transitions(uneven(spark, sf), ["home", "band"], ["band"], daily()), "prob")


@query(_uneven(ORACLE["state_durations"]))
def long_durations(spark, sf):
    return _round(sequences.durations(uneven(spark, sf), ["home", "band"], ["band"], block=daily()), "seconds", digits=3)


@query(_uneven(ORACLE["state_intervals"]))
def long_intervals(spark, sf):
    return sequences.intervals(uneven(spark, sf), ["home"], daily()).drop("ord")


@query(_uneven(ORACLE["compressed_vectors"]))
def long_vectors(spark, sf):
    """Masks of homes that are cut by date, compressed."""
    v = vectors.event_vectors(uneven(spark, sf), ["home"], SENSORS, daily())
    return vectors.compressed(v, ["home"], ("ts", "ord"), daily())


@query(_uneven(ORACLE["sample_and_hold"]))
def long_hold(spark, sf):
    """The hourly grid, in blocks of a day."""
    return vectors.sample_and_hold(uneven(spark, sf), ["home"], SENSORS, "2024-01-01 00:00:00", 3600, 720, block_points=24)


@query("SELECT l_returnflag AS flag, count(*) AS n, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.05), 4) AS p05, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.99), 4) AS p99 FROM lineitem GROUP BY l_returnflag")
def large_percentiles(spark, sf):
    """Exact percentiles of three groups that have all rows, none of which any task holds: at most 1,000 values."""
    from lumenlog.operators.percentiles import joined, percentiles

    l = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    found = percentiles(l, ["flag"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p99": 0.99}, most=1000)
    return _round(joined(l.groupBy("flag").agg(F.count(F.lit(1)).alias("n")), found, ["flag"]), "p05", "p50", "p99", digits=4)


@query(f"WITH {EV}, a AS (SELECT sensor, count(*) AS n FROM ev WHERE ts < TIMESTAMP '{SPLIT}' AND bit = 1 GROUP BY sensor), b AS (SELECT sensor, count(*) AS n FROM ev WHERE ts >= TIMESTAMP '{SPLIT}' AND bit = 0 AND state <> '{OTHER}' GROUP BY sensor), ra AS (SELECT row_number() OVER (ORDER BY n DESC, sensor) AS rank, sensor, n / sum(n) OVER () AS s FROM a), rb AS (SELECT row_number() OVER (ORDER BY n DESC, sensor) AS rank, sensor, n / sum(n) OVER () AS s FROM b), d AS (SELECT abs(coalesce(ra.s, 0) - coalesce(rb.s, 0)) AS gap, coalesce(ra.sensor = rb.sensor, false) AS same FROM ra FULL JOIN rb USING (rank)) SELECT count(*) AS n_ranks, round(avg(gap), 6) AS mean_distance, round(sum(gap), 6) AS distance, count(*) FILTER (same) AS same_key FROM d")
def ranked_distance(spark, sf):
    """How far the shares of sensors lie apart, rank by rank, in two parts of the log."""
    e, split = log(spark, sf), F.lit(SPLIT).cast("timestamp_ntz")
    count = lambda x: x.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"))
    out = stats.ranked_distance(count(e.filter((F.col("ts") < split) & (F.col("bit") == 1))), count(e.filter((F.col("ts") >= split) & (F.col("bit") == 0) & (F.col("state") != OTHER))), "sensor")
    return _round(out, "mean_distance", "distance")


_MANY = "tp AS (SELECT sequence FROM (SELECT sequence, count(*) AS c FROM g GROUP BY sequence) ORDER BY c DESC, sequence LIMIT 1000)"


@query(_uneven(f"WITH {_IV}, {_span_grams(7)}, {_MANY} SELECT home, sequence, start_time, end_time FROM g WHERE sequence IN (SELECT sequence FROM tp)"))
def long_occurrences(spark, sf):
    """Where the thousand most frequent sequences of two to seven intervals stand, in homes that are cut by date."""
    held = stored(sequences.intervals(uneven(spark, sf), ["home"], daily()))
    named = held.withColumnRenamed("start_time", "ts")
    counts = sequences.ngrams(named, ["home"], 2, 7).groupBy("sequence").agg(F.count(F.lit(1)).alias("c"))
    return sequences.occurrences(held, ["home"], counts.orderBy(F.desc("c"), "sequence").limit(1000), block=daily("start_time"))


_BOTH = _IV.replace(f"{EV},", f"{INTERVAL_TABLES},", 1)
_POINTS = "pt AS (SELECT home, start_time AS t FROM (SELECT *, row_number() OVER (PARTITION BY home ORDER BY start_time, ord) AS r FROM iv) WHERE r > 1), ch AS (SELECT tr.home, tr.category, tr.ord, count(pt.t) AS n FROM tr LEFT JOIN pt ON tr.home = pt.home AND tr.start_time < pt.t AND pt.t < tr.end_time GROUP BY ALL)"


@query(_uneven(f"WITH {_BOTH}, {_POINTS} SELECT category, count(*) AS n_spans, CAST(sum(n) AS BIGINT) AS n_inside FROM ch GROUP BY category"))
def changes_inside(spark, sf):
    """Changes of state strictly inside labelled spans, by label, in homes that are cut by date."""
    e = uneven(spark, sf)
    return intervals.series_metrics(sequences.intervals(e, ["home"], daily()), truths(e), ["home"], [OTHER], block=daily())[1]


@query(f"WITH {_BOTH}, {_POINTS}, d AS (SELECT home, state, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS s FROM iv), i AS (SELECT home, count(*) AS n_spans, CAST(sum(n) AS BIGINT) AS n_inside FROM ch GROUP BY home) SELECT home, count(*) AS n_intervals, count(*) - 1 AS n_transitions, count(DISTINCT state) FILTER (state <> '{OTHER}') AS n_states, count(*) FILTER (state = '{OTHER}') AS n_other, round(coalesce(sum(s) FILTER (state = '{OTHER}'), 0) / sum(s), 6) AS other_ratio, coalesce(any_value(n_spans), 0) AS n_spans, coalesce(any_value(n_inside), 0) AS n_inside FROM d LEFT JOIN i USING (home) GROUP BY home")
def series_metrics(spark, sf):
    """Intervals, unmapped time and changes inside labels of each home."""
    e = log(spark, sf)
    return _round(intervals.series_metrics(sequences.intervals(e, ["home"]), truths(e), ["home"], [OTHER])[0], "other_ratio")


@query(f"WITH {EV}, n AS (SELECT *, greatest(0.0, (epoch_us(lead(ts) OVER (PARTITION BY home ORDER BY ts, ord)) - epoch_us(ts)) / 1e6) AS s, lead(ts) OVER (PARTITION BY home ORDER BY ts, ord) AS nt FROM ev), h AS (SELECT band, sensor AS name, s * (1 + k % 3) AS x FROM n WHERE nt IS NOT NULL UNION ALL SELECT band, 'hall', s FROM n WHERE nt IS NOT NULL AND bit = 1), g AS (SELECT band, name, sum(x) / 3600 AS hours FROM h GROUP BY ALL) SELECT band, name, round(hours, 6) AS hours, round(hours / sum(hours) OVER (PARTITION BY band), 6) AS share FROM g")
def occupancy_hours(spark, sf):
    """Hours of each place by band, where a row says who is where until the next one."""
    e = log(spark, sf)
    who = F.when(F.col("bit") == 1, F.create_map(F.col("sensor"), F.array_repeat(F.lit("r"), F.pmod("k", F.lit(3)).cast("int") + 1), F.lit("hall"), F.array(F.lit("r")))).otherwise(F.create_map(F.col("sensor"), F.array_repeat(F.lit("r"), F.pmod("k", F.lit(3)).cast("int") + 1)))
    return _round(stats.occupancy(e.withColumn("who", who), ["home"], ["band"], "who", daily()), "hours", "share")


@query(f"WITH {_MASKS}, {_TOP}, m AS (SELECT mask, arg_min('S' || rank, ROW(d, rank)) AS s FROM (SELECT q.mask, st.rank, bit_count(xor(q.mask, st.mask)) AS d FROM (SELECT DISTINCT mask FROM v) AS q, st) WHERE d <= 1 GROUP BY mask), q AS (SELECT home, ts, ord, coalesce(s, '{OTHER}') AS state FROM v LEFT JOIN m USING (mask)) SELECT home, ts, ord, state FROM (SELECT *, lag(state) OVER (PARTITION BY home ORDER BY ts, ord) AS p FROM q) WHERE p IS NULL OR p <> state")
def state_sequence(spark, sf):
    """From events to the compressed sequence of nearest states."""
    return vectors.state_sequence(log(spark, sf), ["home"], SENSORS, _states(spark, sf)[1], h=1, block=daily())


_WINDOWS = [("learning", 1, 10), ("validation", 12, 20), ("test", 21, 60)]


@query(f"WITH {_IV}, s AS (SELECT home, date_trunc('day', min(start_time)) AS a, max(end_time) AS b FROM iv GROUP BY home), w(role, f, l) AS (VALUES {', '.join(map(str, _WINDOWS))}), d AS (SELECT home, role, a + to_days(f - 1) AS w0, greatest(a + to_days(f - 1), least(a + to_days(l), b)) AS w1 FROM s, w), c AS (SELECT role, iv.home, (epoch_us(least(end_time, w1)) - epoch_us(greatest(start_time, w0))) / 1e6 AS x FROM iv JOIN d ON iv.home = d.home AND end_time > w0 AND start_time < w1 WHERE least(end_time, w1) > greatest(start_time, w0)) SELECT role, count(*) AS n_intervals, count(DISTINCT home) AS n_homes, round(sum(x), 3) AS seconds FROM c GROUP BY role")
def day_windows(spark, sf):
    """Intervals of homes in windows of days for learning, validation and test."""
    held = sequences.intervals(log(spark, sf), ["home"])
    at = splits.day_windows(held, ["home"], spark.createDataFrame(_WINDOWS, "role string, first_day int, last_day int"))
    own = splits.in_windows(held, at, ["home"]).withColumn("s", F.expr("timestampdiff(MICROSECOND, start_time, end_time)") / 1e6)
    return _round(own.groupBy("role").agg(F.count(F.lit(1)).alias("n_intervals"), F.count_distinct("home").alias("n_homes"), F.sum("s").alias("seconds")), "seconds", digits=3)


@query(ORACLE["state_intervals"])
def verified_intervals(spark, sf):
    """Intervals written with a manifest, and read back after every file has been held against it."""
    path = folder(spark)
    sinks.write_verified(sequences.intervals(log(spark, sf), ["home"]).drop("ord"), path)
    return sources.verified(spark, path)


@query(_uneven(f"WITH {_IV}, r0 AS (SELECT state, ts, coalesce(lead(ts) OVER (ORDER BY ts, ord), NULL) AS nt FROM r WHERE home = 0) SELECT ts AS start_time, nt AS end_time, state FROM r0 WHERE nt > ts"))
def series_from_files(spark, sf):
    """The changes of the home that has half of all events, written as files and read as intervals: each change holds until the next one."""
    path = folder(spark)
    changes = sequences.runs(uneven(spark, sf), ["home"], daily()).filter("home = 0")
    changes.orderBy("ts", "ord").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "state").write.option("header", True).csv(path)
    return sources.state_series(spark, path)
