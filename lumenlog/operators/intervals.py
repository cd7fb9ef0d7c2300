"""Intervals: pairing, clipping, merging, overlap joins, as-of rules, containment, hits, greedy matching.

Overlap joins put both sides into buckets of time, so that they are equi-joins on (keys, bucket) with a residual test; a pair is kept in the bucket where
its overlap begins, so it comes once. Nothing is broadcast, and long intervals fall into more buckets instead of widening the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import BANDS, f1_of, micros, overlap_seconds, safe_divide, seconds_between, temporal_iou, time_band
from lumenlog.operators import blocks
from lumenlog.operators.matching import one_to_one
from lumenlog.operators.percentiles import joined, percentiles

BUCKET_SECONDS = 6 * 3600


def clip(rows: DataFrame, start: str, end: str) -> DataFrame:
    """The part of each interval inside [start, end); the overlap test stays apart, so that it can be pushed down."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    inside = rows.filter((F.col("end_time") > s) & (F.col("start_time") < e))
    return inside.withColumn("start_time", F.greatest("start_time", s)).withColumn("end_time", F.least("end_time", e)).filter("end_time > start_time")


def overlapping(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Whole intervals that reach into [start, end)."""
    return rows.filter((F.col("end_time") > F.lit(start).cast("timestamp_ntz")) & (F.col("start_time") < F.lit(end).cast("timestamp_ntz")))


def pair_annotations(marks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start_time, end_time: begin and end marks (kind: begin, end) nested per key; an end closes the last open begin at its depth.

    Depth is a running sum; a begin at depth d pairs with the next end that returns to d - 1. Ends without a begin are left out: the running
    sum is lifted by its own least value so far, which is where such ends stand.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "ord")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    move = F.when(F.col("kind") == "begin", 1).otherwise(-1)
    walked = marks.withColumn("_sum", F.sum(move).over(upto))
    walked = walked.withColumn("_floor", F.least(F.min("_sum").over(upto), F.lit(0)))
    walked = walked.withColumn("_depth", F.col("_sum") - F.col("_floor") + F.when(F.col("kind") == "end", 1).otherwise(0))
    stray = (F.col("kind") == "end") & (F.col("_sum") == F.col("_floor")) & (F.coalesce(F.lag("_floor").over(w), F.lit(0)) > F.col("_floor"))
    walked = walked.withColumn("_stray", stray).filter(~F.col("_stray"))
    at = Window.partitionBy(*keys, "_depth").orderBy("ts", "ord")
    paired = walked.withColumn("_kind", F.lead("kind").over(at)).withColumn("end_time", F.lead("ts").over(at))
    return paired.filter("kind = 'begin' AND _kind = 'end' AND end_time > ts").select(*keys, F.col("ts").alias("start_time"), "end_time")


def pair_in_order(starts: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """The nth start of a key with its nth end."""
    w = Window.partitionBy(*keys).orderBy("ts", "ord")
    a = starts.select(*keys, F.col("ts").alias("start_time"), F.row_number().over(w).alias("nth"))
    b = ends.select(*keys, F.col("ts").alias("end_time"), F.row_number().over(w).alias("nth"))
    return a.join(b, [*keys, "nth"])


def _bucketed(rows: DataFrame, width: int, name: str, before: float = 0.0, after: float = 0.0) -> DataFrame:
    first = F.floor((micros("start_time") / F.lit(1e6) - F.lit(before)) / F.lit(width))
    last = F.floor((micros("end_time") / F.lit(1e6) + F.lit(after)) / F.lit(width))
    return rows.withColumn(name, F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int = BUCKET_SECONDS, tolerance: float = 0.0) -> DataFrame:
    """Pairs of intervals that share time (or lie within `tolerance` seconds), with `overlap`; columns of b other than keys are prefixed b_."""
    left = _bucketed(a, width, "_bucket", tolerance, tolerance)
    right = _bucketed(b, width, "_bucket")
    right = right.select(*keys, "_bucket", *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys))
    pairs = left.join(right, [*keys, "_bucket"])
    shared = overlap_seconds("start_time", "end_time", "b_start_time", "b_end_time")
    gap = seconds_between(F.least("end_time", "b_end_time"), F.greatest("start_time", "b_start_time"))
    near = gap <= tolerance if tolerance > 0 else shared > 0
    begin = F.greatest(F.floor((micros("start_time") / F.lit(1e6) - F.lit(tolerance)) / F.lit(width)), F.floor(micros("b_start_time") / F.lit(1e6) / F.lit(width)))
    return pairs.filter(near & (F.col("_bucket") == begin)).withColumn("overlap", shared).drop("_bucket")


def merge_gaps(rows: DataFrame, keys: list[str], gap_seconds: float) -> DataFrame:
    """keys, start_time, end_time, n: intervals of a key whose distance is at most the gap, as one; a gap of 0 merges nothing, not even what touches."""
    if gap_seconds <= 0:
        return rows.select(*keys, "start_time", "end_time", F.lit(1).cast("long").alias("n"))
    w = Window.partitionBy(*keys).orderBy("start_time", "end_time")
    reach = F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (seconds_between(reach, "start_time") > gap_seconds), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count(F.lit(1)).alias("n")).drop("_island")


def union_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching intervals of a key as one."""
    w = Window.partitionBy(*keys).orderBy("start_time", "end_time")
    reach = F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, "start_time", "end_time", F.when(reach.isNull() | (F.col("start_time") > reach), 1).otherwise(0).alias("_new"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("_island")


def intersections(a: DataFrame, b: DataFrame, keys: list[str], width: int = BUCKET_SECONDS) -> DataFrame:
    """Spans that the unions of both sides share."""
    pairs = overlap_join(union_spans(a, keys), union_spans(b, keys), keys, width)
    return pairs.select(*keys, F.greatest("start_time", "b_start_time").alias("start_time"), F.least("end_time", "b_end_time").alias("end_time"))


def iou_pairs(predictions: DataFrame, truths: DataFrame, keys: list[str], theta: float, width: int = BUCKET_SECONDS) -> DataFrame:
    """Pairs of equal keys whose overlap over hull is theta at least."""
    pairs = overlap_join(predictions, truths, keys, width).withColumn("iou", temporal_iou("start_time", "end_time", "b_start_time", "b_end_time"))
    return pairs.filter(F.col("iou") >= theta)


def relabel_after(rows: DataFrame, keys: list[str], anchor: Column, label: str, window_seconds: float) -> DataFrame:
    """`category` becomes `label` where the latest anchor interval that ended at or before the start did so within the window: an as-of join in one window.

    Ends of anchors and starts of rows are merged into one ordered stream; the running max of ends is the latest one.
    """
    ends = rows.filter(anchor).select(*keys, F.col("end_time").alias("_t"), F.lit(0).alias("_side"), F.col("end_time").alias("_end"), *(F.lit(None).cast(rows.schema[c].dataType).alias(f"_{c}") for c in rows.columns))
    starts = rows.select(*keys, F.col("start_time").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("timestamp_ntz").alias("_end"), *(F.col(c).alias(f"_{c}") for c in rows.columns))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = ends.unionAll(starts).withColumn("_latest", F.max("_end").over(w)).filter("_side = 1")
    out = seen.select("_latest", *(F.col(f"_{c}").alias(c) for c in rows.columns))
    after = F.col("_latest").isNotNull() & (seconds_between("_latest", "start_time") <= window_seconds) & ~anchor
    return out.withColumn("category", F.when(after, F.lit(label)).otherwise(F.col("category"))).drop("_latest")


def contained(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children with `inside`: whether some parent starts at or before and ends at or after them. A running max of parents' ends over both, in order of start."""
    a = parents.select(*keys, "start_time", "end_time", F.lit(0).alias("_side"))
    b = children.select(*keys, "start_time", "end_time", F.lit(1).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("start_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("_side") == 0, F.col("end_time"))).over(w)
    return a.unionAll(b).withColumn("_reach", reach).filter("_side = 1").select(*keys, "start_time", "end_time", F.coalesce(F.col("_reach") >= F.col("end_time"), F.lit(False)).alias("inside"))


def hit_rates(predictions: DataFrame, truths: DataFrame, keys: list[str], category: str, tolerance: float, width: int = BUCKET_SECONDS) -> DataFrame:
    """category, n_truth, hit_overlap, hit_tolerance: truths that a prediction of the same category overlaps, or comes near."""
    every = [*keys, category]
    truths = truths.withColumn("_id", F.struct(*every, "start_time", "end_time"))
    near = overlap_join(truths, predictions.select(*every, "start_time", "end_time"), every, width, tolerance)
    hit = near.groupBy("_id").agg(F.max((F.col("overlap") > 0).cast("int")).alias("_o"), F.lit(1).alias("_n"))
    return truths.join(hit, "_id", "left").groupBy(category).agg(F.count(F.lit(1)).alias("n_truth"), F.sum(F.coalesce("_o", F.lit(0))).alias("hit_overlap"), F.sum(F.coalesce("_n", F.lit(0))).alias("hit_tolerance"))


def greedy_match(pairs: DataFrame, group: list[str], prediction: str, truth: str, score: str) -> DataFrame:
    """One-to-one pairs of each group, best first: by score, prediction and truth, all falling; see `matching`."""
    return one_to_one(pairs.select(*group, prediction, truth, score), group, prediction, truth, [F.col(score), F.col(prediction), F.col(truth)])


def long_enough(rows: DataFrame, least: dict[str, float], default: float, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The intervals that last as many seconds as their category has to, and how many of each category were removed."""
    need = F.lit(default)
    for category, seconds in least.items():
        need = F.when(F.col("category") == category, F.lit(seconds)).otherwise(need)
    marked = rows.withColumn("_ok", seconds_between("start_time", "end_time") >= need)
    counts = marked.groupBy(*by, "category").agg(F.count_if("_ok").alias("kept"), F.count_if(~F.col("_ok")).alias("removed"))
    return marked.filter("_ok").drop("_ok"), counts


def boundary_errors(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of matched pairs (see `iou_pairs`): mean signed and median absolute seconds between starts and between ends, and the mean IoU."""
    s, e = seconds_between("b_start_time", "start_time"), seconds_between("b_end_time", "end_time")
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("start_mean"), F.avg(e).alias("end_mean"), F.avg("iou").alias("mean_iou"))
    for name, x in (("start_median_abs", s), ("end_median_abs", e)):
        out = joined(out, percentiles(pairs, by, F.abs(x), {name: 0.5}), by)
    return out


def activity_truth(marks: DataFrame, keys: list[str], until: Column | None = None) -> DataFrame:
    """keys, start_time, end_time, complete: each start mark with the end mark that follows it; an open one ends at `until`, or at the key's last mark.

    marks: keys (resident, activity), ts, ord, kind (begin, end).
    """
    w = Window.partitionBy(*keys).orderBy("ts", "ord")
    held = marks.withColumns({"_kind": F.lead("kind").over(w), "_next": F.lead("ts").over(w), "_last": F.max("ts").over(Window.partitionBy(*keys))})
    done = F.coalesce(F.col("_kind") == "end", F.lit(False))
    return held.filter("kind = 'begin'").select(*keys, F.col("ts").alias("start_time"), F.when(done, F.col("_next")).otherwise(F.col("_last") if until is None else until).alias("end_time"), done.alias("complete"))


def repeated_marks(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Marks that come more than once; a log that has one is not to be paired."""
    return marks.groupBy(*keys, "ts", "kind").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def category_seconds(predictions: DataFrame, truths: DataFrame, keys: list[str], domain: DataFrame | None = None) -> DataFrame:
    """category with predicted, true and shared seconds, and time-weighted precision, recall and F1.

    Spans of a category count once where they overlap. `domain`: spans (keys, start_time, end_time) outside which nothing counts.
    """
    every = [*keys, "category"]

    def inside(rows: DataFrame) -> DataFrame:
        spans = union_spans(rows, every)
        if domain is None:
            return spans
        pairs = overlap_join(spans, union_spans(domain, keys), keys)
        return pairs.select(*every, F.greatest("start_time", "b_start_time").alias("start_time"), F.least("end_time", "b_end_time").alias("end_time"))

    p, t = inside(predictions), inside(truths)
    length = F.sum(seconds_between("start_time", "end_time"))
    shared = intersections(p, t, every).groupBy("category").agg(length.alias("tp"))
    out = p.groupBy("category").agg(length.alias("predicted")).join(t.groupBy("category").agg(length.alias("true")), "category", "full").join(shared, "category", "left").fillna(0.0)
    precision, recall = safe_divide(F.col("tp"), F.col("predicted")), safe_divide(F.col("tp"), F.col("true"))
    return out.select("category", "tp", "predicted", "true", precision.alias("precision"), recall.alias("recall"), f1_of(precision, recall).alias("f1"))


def expanded(rows: DataFrame, also: DataFrame, default: str = "__unknown__") -> DataFrame:
    """Each interval once for every category of its label: those that `also` (label, categories) has and its own; `default` where it has none of either."""
    every = F.array_distinct(F.array_compact(F.concat(F.coalesce("categories", F.array().cast("array<string>")), F.array("category"))))
    joined = rows.join(also.select(F.lower("label").alias("_label"), "categories"), F.lower("label") == F.col("_label"), "left")
    return joined.withColumn("category", F.explode(F.when(F.size(every) > 0, every).otherwise(F.array(F.lit(default))))).select(*rows.columns)


def split_at_bands(series: DataFrame, keys: list[str], bands: dict[str, tuple[int, int]] = BANDS) -> DataFrame:
    """keys, date, band, start_time, end_time, state: intervals cut at midnights and at the bands' edges; pieces of one state that touch inside a band are one.

    Every interval makes its own pieces, as many as edges it crosses.
    """
    hours = sorted({h for span in bands.values() for h in span if h < 24} | {0})
    first = F.to_date("start_time").cast("timestamp_ntz")
    days = F.sequence(F.lit(0), F.datediff("end_time", "start_time"))
    edges = F.flatten(F.transform(days, lambda d: F.array(*[F.timestamp_add("HOUR", d * 24 + h, first) for h in hours])))
    inner = F.filter(edges, lambda t: (t > F.col("start_time")) & (t < F.col("end_time")))
    cuts = series.withColumn("_at", F.concat(F.array("start_time"), inner, F.array("end_time")))
    pieces = cuts.select(*keys, "state", F.explode(F.expr("transform(sequence(1, size(_at) - 1), i -> struct(get(_at, i - 1) AS start_time, get(_at, i) AS end_time))")).alias("p")).select(*keys, "state", "p.*")
    pieces = pieces.withColumns({"date": F.to_date("start_time"), "band": time_band("start_time", bands)})
    block = [*keys, "date", "band"]
    w = Window.partitionBy(*block).orderBy("start_time")
    new = (F.lag("state").over(w) == F.col("state")) & (F.lag("end_time").over(w) == F.col("start_time"))
    marked = pieces.withColumn("_new", F.when(F.coalesce(new, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*block, "state", "_run").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("_run")


def mapped_predictions(occurrences: DataFrame, mapping: DataFrame, on: list[str], unmapped: str = "Unmapped") -> DataFrame:
    """Occurrences of patterns with the category of their pattern; those of patterns without one, or with `unmapped`, are left out. mapping: on, category."""
    return occurrences.join(mapping.filter(F.col("category").isNotNull() & (F.col("category") != unmapped)).select(*on, "category"), on)


def unseen(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Distinct values of `on` in rows that `known` lacks: sensors of a test log that training never saw, expected runs without an artifact."""
    return rows.select(*on).distinct().join(known.select(*on).distinct(), on, "left_anti")


def by_position(schedule: DataFrame, episodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each planned episode with the actual one at the same place in the day (keys hold the day); null where there is none. Columns of episodes are prefixed actual_."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a = schedule.withColumn("nth", F.row_number().over(w))
    b = episodes.withColumn("nth", F.row_number().over(w))
    b = b.select(*keys, "nth", *(F.col(c).alias(f"actual_{c}") for c in episodes.columns if c not in keys))
    return a.join(b, [*keys, "nth"], "left")


def many_to_one(rows: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the columns of the one row of `keyed` that has their key; a key that comes twice in `keyed` fails the job."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    checked = keyed.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key comes twice: "), F.to_json(F.struct(*on))))).otherwise(F.col("_n")))
    return rows.join(checked.filter("_n = 1").drop("_n"), on)


def in_mode(rows: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows whose time of day lies in [start, end), as HH:mm; where the hour of the end is before that of the start, all that lie before the end."""
    a, b = ([int(x) for x in t.split(":")] for t in (start, end))
    minute = F.hour(ts) * 60 + F.minute(ts)
    before = minute < b[0] * 60 + b[1]
    return rows.filter(before if b[0] < a[0] else (minute >= a[0] * 60 + a[1]) & before)


def first_days(rows: DataFrame, keys: list[str], days: int | None = None, ratio: float | None = None, ts: str = "ts") -> DataFrame:
    """Rows of each key's first `days` calendar days, from the midnight of its first one; or of `ratio` of the days that it has, one at least."""
    w = Window.partitionBy(*keys)
    day = F.datediff(F.to_date(ts), F.to_date(F.min(ts).over(w)))
    n = F.lit(days) if days is not None else F.greatest(F.lit(1), F.floor((F.datediff(F.to_date(F.max(ts).over(w)), F.to_date(F.min(ts).over(w))) + 1) * F.lit(ratio)))
    return rows.withColumn("_day", day).withColumn("_n", n).filter("_day < _n").drop("_day", "_n")


def timeline(events: DataFrame, keys: list[str], dates: DataFrame, step_seconds: int) -> DataFrame:
    """keys, date, at, state: the state that holds just before the end of every step of each date (column date), days before included; at is the step's begin.

    A row for each key, date and step is the result itself; points and events go through one window a key.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(86_400 - step_seconds), F.lit(step_seconds))).alias("_s")
    points = events.select(*keys).distinct().join(dates).select(*keys, "date", steps)
    begin = F.timestamp_add("SECOND", F.col("_s"), F.col("date").cast("timestamp_ntz"))
    points = points.select(*keys, F.timestamp_add("SECOND", F.lit(step_seconds), begin).alias("ts"), F.lit(-1).cast("long").alias("ord"), F.lit(None).cast("string").alias("state"), "date", begin.alias("at"))
    rows = points.unionByName(events.select(*keys, "ts", "ord", "state"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("state", F.last("state", ignorenulls=True).over(w)).filter("at IS NOT NULL AND state IS NOT NULL").select(*keys, "date", "at", "state")


def strictly_inside(points: DataFrame, spans: DataFrame, keys: list[str], by: list[str], block: Column | None = None) -> DataFrame:
    """by, n_spans, n_inside: how many points of a key lie after a span's start and before its end, summed over the spans of each `by` (of their columns).

    points: keys, ts, and where they have one, weight. No span meets a point: both ends of spans go into the points' order, and a span's number is the running count at its end less that at its
    start. At equal times ends come first, then points, then starts. `block` (of ts) cuts keys that are too long for a task.
    """
    weight = F.col("weight").cast("long") if "weight" in points.columns else F.lit(1).cast("long")
    own = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    none = [F.lit(None).cast(spans.schema[c].dataType).alias(f"_by{i}") for i, c in enumerate(by)]
    at = spans.filter("end_time > start_time")
    edge = lambda c, side, sign: at.select(*keys, F.col(c).alias("ts"), F.lit(side).alias("_side"), F.lit(0).cast("long").alias("_w"), F.lit(sign).alias("_sign"), *own)
    stream = points.select(*keys, "ts", F.lit(1).alias("_side"), weight.alias("_w"), F.lit(0).alias("_sign"), *none).unionAll(edge("end_time", 0, 1)).unionAll(edge("start_time", 2, -1))
    order = ("ts", "_side")
    if block is None:
        counted = stream.withColumn("_n", F.sum("_w").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        counted = blocks.folded(stream, keys, block, order, {"_n": ("sum", F.col("_w"))})
    named = [F.col(f"_by{i}").alias(c) for i, c in enumerate(by)]
    return counted.filter("_sign <> 0").groupBy(*named).agg(F.count_if(F.col("_sign") == 1).alias("n_spans"), F.sum(F.col("_sign") * F.col("_n")).alias("n_inside"))


def series_metrics(series: DataFrame, spans: DataFrame, keys: list[str], others: list[str], label: str = "category", block: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Of each key's series of intervals: counts, share of unmapped time and changes of state strictly inside labelled spans; and these changes by label.

    series: keys, start_time, end_time, ord, state. A change is an interval's start, but for a key's first one. First table: keys, n_intervals, n_transitions, n_states, n_other, other_ratio, n_spans, n_inside; second: label, n_spans, n_inside.
    `block` is an expression of ts.
    """
    other, seconds = F.col("state").isin(others), F.greatest(F.lit(0.0), seconds_between("start_time", "end_time"))
    totals = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_intervals"), F.count_distinct(F.when(~other, F.col("state"))).alias("n_states"), F.count_if(other).alias("n_other"), safe_divide(F.coalesce(F.sum(F.when(other, seconds)), F.lit(0.0)), F.sum(seconds)).alias("other_ratio"))
    first = series.groupBy(*keys).agg(F.min(F.struct("start_time", "ord"))["start_time"].alias("ts"))
    # the first start counts once and is taken back once
    points = series.select(*keys, F.col("start_time").alias("ts"), F.lit(1).alias("weight")).unionAll(first.select(*keys, "ts", F.lit(-1).alias("weight")))
    inside = strictly_inside(points, spans, keys, [*keys, label], block)
    per = inside.groupBy(*keys).agg(F.sum("n_spans").alias("n_spans"), F.sum("n_inside").alias("n_inside"))
    one = totals.join(per, keys, "left").fillna(0, ["n_spans", "n_inside"]).select(*keys, "n_intervals", (F.col("n_intervals") - 1).alias("n_transitions"), "n_states", "n_other", "other_ratio", "n_spans", "n_inside")
    return one, inside.groupBy(label).agg(F.sum("n_spans").alias("n_spans"), F.sum("n_inside").alias("n_inside"))
