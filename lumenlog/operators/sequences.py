"""States of homes over time: runs, transitions, durations, n-grams, mined patterns.

A series is a DataFrame with keys (a home, and what it is split by), `ts`, `ord` (a tie-break) and `state`. Every window is partitioned by the
keys, so homes spread over the cluster; no operator sorts all rows together. Where one key may be too long for a task, `block` (see `blocks`) cuts
it: same rows, and no task holds more of a key than a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import ARROW, filter_reason, seconds_between, time_band
from lumenlog.operators import blocks
from lumenlog.operators.percentiles import joined, percentiles
from lumenlog.operators.search import occurrences  # noqa: F401  a part of this module's API

ORDER = ("ts", "ord")


def runs(series: DataFrame, keys: list[str], block: Column | None = None) -> DataFrame:
    """The first row of every run of one state; rows without a state are left out."""
    series = series.filter(F.col("state").isNotNull())
    if block is None:
        marked = series.withColumn("_last", F.lag("state").over(Window.partitionBy(*keys).orderBy(*ORDER)))
    else:
        marked = blocks.neighbours(series, keys, block, ORDER, before={"_last": F.col("state")})
    return marked.filter(~F.col("state").eqNullSafe(F.col("_last"))).drop("_last")


def steps(series: DataFrame, keys: list[str], block: Column | None = None) -> DataFrame:
    """Each run with the state of the next one; the last run of a key is left out."""
    changes = runs(series, keys, block)
    if block is None:
        moved = changes.withColumn("next_state", F.lead("state").over(Window.partitionBy(*keys).orderBy(*ORDER)))
    else:
        moved = blocks.neighbours(changes, keys, block, ORDER, after={"next_state": F.col("state")})
    return moved.filter(F.col("next_state").isNotNull())


def transitions(series: DataFrame, keys: list[str], by: list[str], block: Column | None = None) -> DataFrame:
    """by, src, dst, cnt, prob: moves inside a key, counted over `by`; chances sum to 1 for each source."""
    counted = steps(series, keys, block).groupBy(*by, F.col("state").alias("src"), F.col("next_state").alias("dst")).agg(F.count(F.lit(1)).alias("cnt"))
    return counted.withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*by, "src")))


def durations(series: DataFrame, keys: list[str], by: list[str], last: float = 1.0, block: Column | None = None) -> DataFrame:
    """by, state, seconds: until the next row of the key; the last row counts `last` seconds."""
    if block is None:
        ahead = series.withColumn("_next", F.lead("ts").over(Window.partitionBy(*keys).orderBy(*ORDER)))
    else:
        ahead = blocks.neighbours(series, keys, block, ORDER, after={"_next": F.col("ts")})
    held = ahead.withColumn("_s", F.coalesce(seconds_between("ts", "_next"), F.lit(last)))
    return held.groupBy(*by, "state").agg(F.sum("_s").alias("seconds"), F.count(F.lit(1)).alias("n_rows"))


def intervals(series: DataFrame, keys: list[str], block: Column | None = None) -> DataFrame:
    """keys, start_time, end_time, state: runs up to the next run; the last ends at the key's last row. Empty intervals are left out."""
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*ORDER)
        marked = series.withColumn("_prev", F.lag("state").over(w)).withColumn("_end", F.max("ts").over(Window.partitionBy(*keys)))
        first = marked.filter(~F.col("state").eqNullSafe(F.col("_prev")))
        ahead = first.withColumn("_next", F.lead("ts").over(w))
    else:
        # a key's last row is known by having none behind it; where its run began earlier, the run's end is that row's time
        marked = blocks.neighbours(series, keys, block, ORDER, before={"_prev": F.col("state")}, after={"_after": F.col("ts")})
        edges = marked.withColumn("_new", ~F.col("state").eqNullSafe(F.col("_prev"))).filter(F.col("_new") | F.col("_after").isNull())
        ahead = blocks.neighbours(edges, keys, block, ORDER, after={"_next": F.col("ts")}).filter("_new").withColumn("_end", F.col("ts"))
    out = ahead.select(*keys, F.col("ts").alias("start_time"), F.coalesce("_next", "_end").alias("end_time"), "state", "ord")
    return out.filter("end_time > start_time")


def ngrams(series: DataFrame, keys: list[str], least: int = 2, most: int = 4) -> DataFrame:
    """Every n-gram of `least` to `most` rows in a row, with the times of its first and last row."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    ahead = series
    for i in range(1, most):
        ahead = ahead.withColumn(f"_s{i}", F.lead("state", i).over(w)).withColumn(f"_t{i}", F.lead("ts", i).over(w))
    names = ["state", *(f"_s{i}" for i in range(1, most))]
    made = [F.when(F.col(names[n - 1]).isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(ARROW, *names[:n]).alias("sequence"), F.col("ts" if n == 1 else f"_t{n - 1}").alias("last_ts"))) for n in range(least, most + 1)]
    grams = F.filter(F.array(*made), lambda x: x.isNotNull())
    return ahead.select(*keys, "ts", "ord", F.explode(grams).alias("g")).select(*keys, "ts", "ord", "g.n", "g.sequence", "g.last_ts")


def ngram_counts(series: DataFrame, keys: list[str], by: list[str], least: int = 2, most: int = 4) -> DataFrame:
    """by, sequence, n, cnt, first_ts, first_ord: counts over compressed runs, with where each was seen first."""
    grams = ngrams(runs(series, keys), keys, least, most)
    return grams.groupBy(*by, "sequence", "n").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("ts", "ord")).alias("_f")).select(*by, "sequence", "n", "cnt", F.col("_f.ts").alias("first_ts"), F.col("_f.ord").alias("first_ord"))


def top_patterns(counts: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k most frequent of each `by`; ties go to the shorter, then to what was seen first."""
    order = [F.desc("cnt"), "n", "first_ts", "first_ord", "sequence"]
    if not by:
        return counts.orderBy(*order).limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def transaction_support(held: DataFrame, keys: list[str], others: list[str], min_support: int, least: int = 2, most: int = 4, most_median: float = 3600.0, most_p90: float = 7200.0) -> DataFrame:
    """Support of n-grams of intervals over date and band buckets, spans (median and 90th percentile), and why a pattern is filtered."""
    w = Window.partitionBy(*keys).orderBy("start_time", "ord")
    rows = held
    for i in range(1, most):
        rows = rows.withColumn(f"_s{i}", F.lead("state", i).over(w)).withColumn(f"_e{i}", F.lead("end_time", i).over(w))
    names = ["state", *(f"_s{i}" for i in range(1, most))]
    made = [F.when(F.col(names[n - 1]).isNotNull(), F.struct(F.array(*names[:n]).alias("sequence"), F.col(f"_e{n - 1}").alias("end_time"))) for n in range(least, most + 1)]
    bucket = F.concat_ws("_", F.to_date("start_time").cast("string"), time_band("start_time"))
    grams = rows.select(*keys, bucket.alias("bucket"), "start_time", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("g"))
    grams = grams.select(*keys, "bucket", F.col("g.sequence").alias("seq"), seconds_between("start_time", "g.end_time").alias("span"))
    total = held.select(F.count_distinct(bucket).alias("n_buckets"))
    out = grams.groupBy("seq").agg(F.count_distinct("bucket").alias("support"), F.count(F.lit(1)).alias("cnt")).filter(F.col("support") >= min_support)
    out = joined(out, percentiles(grams, ["seq"], "span", {"median_span": 0.5, "p90_span": 0.9}), ["seq"]).join(F.broadcast(total))  # one row
    reason = filter_reason("seq", F.col("median_span"), F.col("p90_span"), others, most_median, most_p90)
    return out.select(F.concat_ws(ARROW, "seq").alias("sequence"), "support", "cnt", (F.col("support") / F.col("n_buckets")).alias("support_ratio"), "median_span", "p90_span", reason.alias("filter_reason"))


def paths(edges: DataFrame, by: list[str], least: int, most: int, theta: float, revisit: bool) -> DataFrame:
    """by, sequence, n, joint, least_step: all walks of `least` to `most` states along edges of at least theta; one join a step."""
    e = edges.filter(F.col("prob") >= theta).select(*by, "src", "dst", "prob")
    at = e.select(*by, F.array("src", "dst").alias("states"), F.col("prob").alias("joint"), F.col("prob").alias("least_step")).filter(F.lit(revisit) | (F.get("states", F.lit(0)) != F.get("states", F.lit(1))))
    found = [at] if least <= 2 else []
    for n in range(3, most + 1):
        at = at.withColumn("src", F.element_at("states", -1)).join(e, [*by, "src"])
        if not revisit:
            at = at.filter(~F.array_contains("states", F.col("dst")))
        at = at.select(*by, F.concat("states", F.array("dst")).alias("states"), (F.col("joint") * F.col("prob")).alias("joint"), F.least("least_step", "prob").alias("least_step"))
        if n >= least:
            found.append(at)
    every = reduce(DataFrame.unionAll, found)
    return every.select(*by, F.concat_ws(ARROW, "states").alias("sequence"), F.size("states").alias("n"), "joint", "least_step")


def window_support(series: DataFrame, keys: list[str], hours: int, least: int = 2, most: int = 3) -> DataFrame:
    """Support and confidence of n-grams over fixed windows from the first row on; windows without rows count as well.

    keys, sequence, n, windows_with, n_windows, support, confidence: confidence is the count over the count of the sequence without its last state.
    """
    step = hours * 3600 * 1_000_000
    start = series.groupBy(*keys).agg(F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    slot = F.expr(f"timestampdiff(MICROSECOND, _t0, ts) div {step}")
    slotted = series.join(start, keys).withColumn("slot", slot)
    total = start.select(*keys, (F.expr(f"timestampdiff(MICROSECOND, _t0, _t1) div {step}") + 1).alias("n_windows"))
    grams = ngrams(slotted.select(*keys, "slot", "ts", "ord", "state"), [*keys, "slot"], 1, most)
    counts = grams.groupBy(*keys, "sequence", "n").agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("slot").alias("windows_with"))
    whole = counts.filter(F.col("n") >= least)
    prefix = counts.select(*keys, F.col("sequence").alias("_p"), F.col("cnt").alias("prefix_cnt"))
    whole = whole.withColumn("_p", F.regexp_replace("sequence", "->[^>]*$", "")).join(prefix, [*keys, "_p"]).join(total, keys)
    return whole.select(*keys, "sequence", "n", "windows_with", "n_windows", (F.col("windows_with") / F.col("n_windows")).alias("support"), (F.col("cnt") / F.col("prefix_cnt")).alias("confidence"))


def by_band(series: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of each band by itself: a state goes on over the times that lie in other bands, and begins anew in each band."""
    return runs(series, [*keys, "band"])


def filtered_edges(edges: DataFrame, by: list[str], theta: float, excluded: list[str]) -> DataFrame:
    """Edges without excluded states on either end, whose chance over what is left of their source is theta at least."""
    kept = edges.filter(~F.col("src").isin(excluded) & ~F.col("dst").isin(excluded))
    return kept.withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*by, "src"))).filter(F.col("prob") >= theta)
