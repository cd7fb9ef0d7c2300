"""Queries of evaluations, labels, splits, joins by position, catalogs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog import functions as fn
from lumenlog.functions import OTHER
from lumenlog.operators import evaluation, intervals, patterns, scoring, sequences, vectors
from lumenlog.operators.shared import stored
from lumenlog.plans.adapter import EV, INTERVAL_TABLES, LABELS, SENSORS, SPLIT, log, predictions, runs_sql, truths
from lumenlog.plans.queries import _BAND, _IV, _LOOP, _MASKS, _SELF, _TRIP, _grams_sql, _round, _span_grams, _vectors, query

_LIST = ", ".join(f"'{x}'" for x in LABELS)
_M = evaluation.METRICS
_SC = [f"{s}_{m}" for s in evaluation.SCOPES for m in _M]

# Interpretations --------------------------------------------------------------------------------------------------------

_PATTERNS = f"""{_IV}, {_span_grams(4)}, pt AS (
  SELECT band, sequence, c, CAST(row_number() OVER (ORDER BY band, sequence) AS INTEGER) AS i
  FROM (SELECT {_BAND.format(t='start_time')} AS band, sequence, count(*) AS c FROM g GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY band ORDER BY count(*) DESC, sequence) <= 12
    UNION ALL SELECT 'All', 'view->view', 0 UNION ALL SELECT 'All', 'view->click', 0)
), pa AS (
  SELECT band || ':' || sequence AS pattern_id, band, sequence, list_sort(list_distinct([([{_LIST}])[c % 10 + 1], ([{_LIST}])[(c + i) % 7 + 1]])) AS labels,
    CASE WHEN i % 9 = 4 THEN 'missing' WHEN i % 9 = 7 THEN 'unknown' ELSE 'valid' END AS status FROM pt
)"""
_PATTERNS = _PATTERNS.replace(f"{EV},", f"{INTERVAL_TABLES},", 1)


def _audit_sql(by: tuple[str, ...] = (), on: tuple[str, ...] = ()) -> str:
    """From patterns (pa), n-grams (g) and truths (tr) to details (de); by: leading columns of patterns, on: those that n-grams have as well."""
    b, p, a, using = "".join(f"{c}, " for c in by), "".join(f"pa.{c}, " for c in by), "".join(f"a.{c}, " for c in by), ", ".join([*by, "pattern_id"])
    same = "".join(f" AND pa.{c} = g.{c}" for c in on)
    return f"""oc AS (
  SELECT {p}pa.pattern_id, g.home, g.start_time, g.end_time, pa.band = 'All' OR {_BAND.format(t='g.start_time')} = pa.band AS assigned,
    {_BAND.format(t='g.start_time')} = {_BAND.format(t="(g.end_time - INTERVAL 1 MICROSECOND)")} AS same,
    CAST(g.start_time AS DATE) = CAST(g.end_time - INTERVAL 1 MICROSECOND AS DATE) AND g.end_time > g.start_time AS one_day, pa.band = 'All' AS every
  FROM pa JOIN g ON pa.sequence = g.sequence{same}
), ac AS (SELECT *, assigned AND (every OR same AND one_day) AS accepted, assigned AND CASE WHEN every THEN NOT same ELSE NOT (same AND one_day) END AS crossing FROM oc),
cn AS (SELECT {b}pattern_id, count(*) AS n_matching, count(*) FILTER (assigned) AS n_assigned, count(*) FILTER (crossing) AS n_crossing, count(*) FILTER (accepted) AS n_occurrences FROM ac GROUP BY ALL),
sh AS (SELECT {a}a.pattern_id, b.category, sum((epoch_us(least(a.end_time, b.end_time)) - epoch_us(greatest(a.start_time, b.start_time))) / 1e6) AS s FROM ac AS a JOIN tr AS b ON a.accepted AND a.home = b.home AND a.start_time < b.end_time AND b.start_time < a.end_time GROUP BY ALL),
tl AS (SELECT {b}pattern_id, total, list(category ORDER BY category) AS true_labels FROM (SELECT *, sum(s) OVER (PARTITION BY {using}) AS total FROM sh) WHERE s >= 0.15 * total GROUP BY ALL),
jn AS (
  SELECT {p}pa.pattern_id, pa.band, pa.sequence, pa.labels, pa.status, coalesce(n_matching, 0) AS n_matching, coalesce(n_assigned, 0) AS n_assigned, coalesce(n_crossing, 0) AS n_crossing, coalesce(n_occurrences, 0) AS n_occurrences,
    true_labels, coalesce(total, 0.0) AS overlap_seconds, coalesce(n_occurrences, 0) > 0 AS occurs, total IS NOT NULL AS defined, len(list_intersect(labels, coalesce(true_labels, []))) AS b, len(labels) AS np, coalesce(len(true_labels), 0) AS nt
  FROM pa LEFT JOIN cn USING ({using}) LEFT JOIN tl USING ({using})
), de AS (
  SELECT *, CASE WHEN occurs THEN 'matched' ELSE 'no_occurrence' END AS occurrence_status, CASE WHEN occurs AND defined THEN 'defined' ELSE 'no_adl_overlap' END AS truth_status,
    {', '.join(f"CASE WHEN occurs AND defined THEN CASE WHEN status = 'valid' THEN {x} ELSE 0.0 END END AS conditional_{m}, CASE WHEN NOT occurs THEN 0.0 WHEN defined THEN CASE WHEN status = 'valid' THEN {x} ELSE 0.0 END END AS end_to_end_{m}" for m, x in {'exact_set_match': 'CAST(b = np AND b = nt AS DOUBLE)', 'jaccard': 'b / (np + nt - b)', 'precision': 'b / np', 'recall': 'CASE WHEN nt > 0 THEN b / nt ELSE 0.0 END', 'f1': '2.0 * b / (np + nt)'}.items())}
  FROM jn
)"""


_PATTERNS = f"{_PATTERNS}, {_audit_sql()}"


def _interpreted(held: DataFrame) -> DataFrame:
    """Twelve frequent sequences of each band and two for all, with made-up labels."""
    grams = sequences.ngrams(held.withColumnRenamed("start_time", "ts"), ["home"], 2, 4)
    counts = grams.groupBy(fn.time_band("ts").alias("band"), "sequence").agg(F.count(F.lit(1)).alias("c"))
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("c"), "sequence"))).filter("_r <= 12").drop("_r")
    more = held.sparkSession.range(2).select(F.lit("All").alias("band"), F.when(F.col("id") == 0, "view->view").otherwise("view->click").alias("sequence"), F.lit(0).cast("long").alias("c"))
    i = F.row_number().over(Window.orderBy("band", "sequence"))  # fifty patterns
    labels = F.array(*map(F.lit, LABELS))
    return top.unionByName(more).withColumn("i", i).select(
        F.concat("band", F.lit(":"), "sequence").alias("pattern_id"), F.lit(None).cast("string").alias("group_id"), "band", "sequence",
        F.array_sort(F.array_distinct(F.array(F.get(labels, (F.col("c") % 10).cast("int")), F.get(labels, ((F.col("c") + F.col("i")) % 7).cast("int"))))).alias("labels"),
        F.when(F.col("i") % 9 == 4, "missing").when(F.col("i") % 9 == 7, "unknown").otherwise("valid").alias("status"),
    )


def _evaluated(spark, sf, period: tuple[str, str] | None = None) -> dict[str, DataFrame]:
    e = log(spark, sf)
    held = sequences.intervals(e, ["home"])
    known = _interpreted(held if period is None else intervals.clip(held, *period))
    return evaluation.evaluated(known, held, truths(e).drop("ord"), ["home"], 0.15, period=period)


def _details(spark, sf) -> DataFrame:
    return _evaluated(spark, sf)["details"]


@query(f"WITH {_PATTERNS} SELECT pattern_id, band, sequence, array_to_string(labels, ';') AS labels, status, n_matching, n_assigned, n_crossing, n_occurrences, coalesce(array_to_string(true_labels, ';'), '') AS true_labels, round(overlap_seconds, 3) AS overlap_seconds, occurrence_status, truth_status, {', '.join(f'round({c}, 6) AS {c}' for c in _SC)} FROM de")
def interpretation_scores(spark, sf):
    """Predicted and true label sets of patterns, conditionally and end to end."""
    out = _details(spark, sf).withColumns({c: F.coalesce(F.array_join(c, ";"), F.lit("")) for c in ("labels", "true_labels")})
    return _round(_round(out, *_SC), "overlap_seconds", digits=3)


def _summary_sql(by: str, source: str, tables: str = _PATTERNS) -> str:
    rate = "coalesce({} / nullif({}, 0), 0.0)"
    rates = {"occurrence_coverage": rate.format("n_matched", "n_patterns"), "truth_coverage": rate.format("n_truth_defined", "n_matched"), "missing_rate": rate.format("n_missing", "n_patterns"), "crossing_rate": rate.format("n_crossing", "n_assigned")}
    counts = "count(*) AS n_patterns, count(*) FILTER (occurs) AS n_matched, count(*) FILTER (occurs AND defined) AS n_truth_defined, count(*) FILTER (occurs AND NOT defined) AS n_no_overlap, CAST(sum(n_assigned) AS BIGINT) AS n_assigned, CAST(sum(n_crossing) AS BIGINT) AS n_crossing, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("valid", "missing", "unknown")) + ", count(conditional_f1) AS n_conditional_evaluable, count(end_to_end_f1) AS n_end_to_end_evaluable"
    means = ", ".join(f"round(avg({s}_{m}), 6) AS {s}_mean_{m}" for s in evaluation.SCOPES for m in _M)
    return f"WITH {tables}, su AS (SELECT {by}, {counts}, {means} FROM {source} GROUP BY {by}) SELECT *, {', '.join(f'round({x}, 6) AS {n}' for n, x in rates.items())} FROM su"


_ROUNDED = ["occurrence_coverage", "truth_coverage", "missing_rate", "crossing_rate", *(f"{s}_mean_{m}" for s in evaluation.SCOPES for m in _M)]


@query(_summary_sql("band", "de"))
def interpretation_summary(spark, sf):
    """Coverages and means of the patterns of each band."""
    return _round(evaluation.summary(_details(spark, sf), ["band"]), *_ROUNDED)


@query(_summary_sql("label", "(SELECT *, unnest(true_labels) AS label FROM de)"))
def label_summary(spark, sf):
    """The same by true label."""
    return _round(evaluation.label_summary(_details(spark, sf), "true_labels"), *_ROUNDED)


_PERIOD = ("2024-01-08", SPLIT)
_CLIPPED = _PATTERNS.replace("iv AS (", "iv0 AS (", 1).replace("tr AS (", "tr0 AS (", 1)
_CLIP = "SELECT * REPLACE (greatest(start_time, TIMESTAMP '2024-01-08') AS start_time, least(end_time, TIMESTAMP '2024-01-22') AS end_time) FROM {0} WHERE end_time > TIMESTAMP '2024-01-08' AND start_time < TIMESTAMP '2024-01-22'"
_CLIPPED = _CLIPPED.replace(", a AS (SELECT", f", iv AS ({_CLIP.format('iv0')}), tr AS ({_CLIP.format('tr0')}), a AS (SELECT", 1)


@query(_summary_sql("band", "de", _CLIPPED))
def method_by_band(spark, sf):
    """One method from search to summary, on two weeks of the log."""
    return _round(_evaluated(spark, sf, _PERIOD)["bands"], *_ROUNDED)


@query(_summary_sql("frequency_band", "(SELECT *, (['Low', 'Middle', 'High'])[ntile(3) OVER (ORDER BY n_occurrences, band, sequence, pattern_id)] AS frequency_band FROM de WHERE n_occurrences > 0)", _CLIPPED))
def method_by_frequency(spark, sf):
    """The same in thirds of patterns, by how often they occur."""
    return _round(_evaluated(spark, sf, _PERIOD)["frequencies"], *_ROUNDED)


# Methods and conditions -------------------------------------------------------------------------------------------------

_MERGED = """mg AS (SELECT method, home, category, min(start_time) AS start_time, max(end_time) AS end_time FROM (SELECT *, sum(CASE WHEN r IS NULL OR epoch_us(start_time) - epoch_us(r) > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY method, home, category ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS isl
  FROM (SELECT home % 3 AS method, home, category, start_time, end_time, max(end_time) OVER (PARTITION BY home % 3, home, category ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM pr)) GROUP BY method, home, category, isl),
ok AS (SELECT *, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 >= CASE category WHEN 'Sleeping' THEN 1800 WHEN 'Meal_Preparation' THEN 600 ELSE 900 END AS ok FROM mg)"""
_LEAST = {"Sleeping": 1800.0, "Meal_Preparation": 600.0}


def _by_method(spark, sf):
    e = log(spark, sf)
    p = predictions(e).select((F.col("home") % 3).alias("method"), "home", "category", "start_time", "end_time")
    return evaluation.processed_hits(p, truths(e).drop("ord"), ["home"], 43_200.0, _LEAST, 900.0, 7200.0)


@query(f"WITH {INTERVAL_TABLES}, {_MERGED}, mt AS (SELECT DISTINCT home % 3 AS method FROM pr), h AS (SELECT a.method, b.home, b.category, b.ord, max(CAST(a.start_time < b.end_time AND b.start_time < a.end_time AS INTEGER)) AS o FROM tr AS b JOIN ok AS a ON a.ok AND a.home = b.home AND a.category = b.category AND a.start_time <= b.end_time + INTERVAL 7200 SECOND AND b.start_time <= a.end_time + INTERVAL 7200 SECOND GROUP BY ALL) SELECT method, category, count(*) AS n_truth, CAST(sum(coalesce(o, 0)) AS BIGINT) AS hit_overlap, count(o) AS hit_tolerance FROM mt CROSS JOIN tr LEFT JOIN h USING (method, home, category, ord) GROUP BY method, category")
def processed_hits(spark, sf):
    """Hit rates of each method's predictions after merging and the duration filter."""
    return _by_method(spark, sf)[2]


@query(f"WITH {INTERVAL_TABLES}, {_MERGED} SELECT method, category, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS removed FROM ok GROUP BY ALL")
def removed_by_method(spark, sf):
    """How many merged predictions of each method last too short."""
    return _by_method(spark, sf)[1]


_SWEEP = [(k, h) for k in (4, 8) for h in (0, 1, 2)]
_RANKED = "st AS (SELECT CAST(row_number() OVER (ORDER BY cnt DESC, f) AS INTEGER) AS rank, mask, cnt FROM (SELECT mask, count(*) AS cnt, min(ROW(ts, ord, home)) AS f FROM vc GROUP BY mask) ORDER BY rank LIMIT 8)"
_MAPPED = " UNION ALL ".join(f"SELECT {k} AS n_states, {h} AS threshold, home, ts, ord, coalesce(s, '{OTHER}') AS state FROM vc LEFT JOIN (SELECT mask, arg_min('S' || rank, ROW(d, rank)) AS s FROM ds WHERE rank <= {k} AND d <= {h} GROUP BY mask) AS m USING (mask)" for k, h in _SWEEP)


@query(f"WITH {_MASKS}, {_RANKED}, ds AS (SELECT q.mask, st.rank, bit_count(xor(q.mask, st.mask)) AS d FROM (SELECT DISTINCT mask FROM vc) AS q, st), mp AS ({_MAPPED}) SELECT n_states, threshold, {_BAND.format(t='ts')} AS band, count(*) AS n, count(*) FILTER (state = '{OTHER}') AS n_other, count(DISTINCT state) AS n_used FROM mp GROUP BY ALL")
def condition_sweep(spark, sf):
    """Numbers of states and Hamming thresholds: how much of each band is mapped, and to how many states."""
    v = vectors.compressed(_vectors(spark, sf), ["home"], ("ts", "ord"))
    rows = evaluation.swept(v, _SWEEP, ("ts", "ord", "home"))
    return rows.groupBy("n_states", "threshold", fn.time_band("ts").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == OTHER).alias("n_other"), F.count_distinct("state").alias("n_used"))


_THIRTY = [(k, h) for k in (2, 4, 6, 8, 12) for h in range(6)]
_RANKED12 = _RANKED.replace("LIMIT 8", "LIMIT 12")
_CV = f"cv(n_states, threshold) AS (VALUES {', '.join(f'({k}, {h})' for k, h in _THIRTY)})"
_SWEPT = f"""{_MASKS.replace(f'{EV},', f'{INTERVAL_TABLES},', 1)}, {_RANKED12}, ds AS (SELECT q.mask, st.rank, bit_count(xor(q.mask, st.mask)) AS d FROM (SELECT DISTINCT mask FROM vc) AS q, st), {_CV},
nm AS (SELECT n_states, threshold, mask, arg_min('S' || rank, ROW(d, rank)) AS s FROM ds JOIN cv ON rank <= n_states AND d <= threshold GROUP BY ALL),
mp AS (SELECT cv.n_states, cv.threshold, home, ts, ord, coalesce(s, '{OTHER}') AS state FROM vc CROSS JOIN cv LEFT JOIN nm ON nm.n_states = cv.n_states AND nm.threshold = cv.threshold AND nm.mask = vc.mask),
rr AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY n_states, threshold, home ORDER BY ts, ord) AS _p, max(ts) OVER (PARTITION BY n_states, threshold, home) AS last_ts FROM mp) WHERE _p IS NULL OR _p <> state),
iv AS (SELECT * FROM (SELECT n_states, threshold, home, ts AS start_time, coalesce(lead(ts) OVER (PARTITION BY n_states, threshold, home ORDER BY ts, ord), last_ts) AS end_time, state, ord FROM rr) WHERE end_time > start_time),
{_span_grams(3).replace('PARTITION BY home', 'PARTITION BY n_states, threshold, home').replace('SELECT home, start_time', 'SELECT n_states, threshold, home, start_time')},
pt AS (SELECT n_states, threshold, {_BAND.format(t='start_time')} AS band, sequence, count(*) AS c FROM g GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY n_states, threshold, band ORDER BY c DESC, sequence) AS i FROM pt),
pa AS (SELECT n_states, threshold, CAST(i % 2 AS INTEGER) AS run, band || ':' || sequence AS pattern_id, band, sequence, list_sort(list_distinct([([{_LIST}])[c % 10 + 1], ([{_LIST}])[(c + i) % 7 + 1]])) AS labels, CASE WHEN i = 6 THEN 'missing' ELSE 'valid' END AS status FROM pk WHERE i <= 6),
{_audit_sql(('n_states', 'threshold', 'run'), ('n_states', 'threshold'))}"""


def _swept(spark, sf) -> dict[str, DataFrame]:
    e = log(spark, sf)
    v = vectors.compressed(vectors.event_vectors(e, ["home"], SENSORS), ["home"], ("ts", "ord"))
    every = evaluation.CONDITION
    series = stored(sequences.intervals(evaluation.swept(v, _THIRTY, ("ts", "ord", "home")), [*every, "home"]))
    grams = sequences.ngrams(series.withColumnRenamed("start_time", "ts"), [*every, "home"], 2, 3)
    counts = grams.groupBy(*every, fn.time_band("ts").alias("band"), "sequence").agg(F.count(F.lit(1)).alias("c"))
    top = counts.withColumn("i", F.row_number().over(Window.partitionBy(*every, "band").orderBy(F.desc("c"), "sequence"))).filter("i <= 6")
    labels = F.array(*map(F.lit, LABELS))
    known = stored(top.select(  # six of a band, read for several steps
        *every, (F.col("i") % 2).cast("int").alias("run"), F.concat("band", F.lit(":"), "sequence").alias("pattern_id"), F.lit(None).cast("string").alias("group_id"), "band", "sequence",
        F.array_sort(F.array_distinct(F.array(F.get(labels, (F.col("c") % 10).cast("int")), F.get(labels, ((F.col("c") + F.col("i")) % 7).cast("int"))))).alias("labels"),
        F.when(F.col("i") == 6, "missing").otherwise("valid").alias("status"),
    ))
    return evaluation.swept_evaluation(series, known, truths(e).drop("ord"), ["home"], 0.15)


@query(_summary_sql("n_states, threshold, run", "de", _SWEPT))
def sweep_runs(spark, sf):
    """Thirty conditions of two runs each, in one scan of the events."""
    return _round(_swept(spark, sf)["runs"], *_ROUNDED)


@query(_summary_sql("n_states, threshold, band", "de", _SWEPT))
def sweep_bands(spark, sf):
    """The same by band, over a condition's runs."""
    return _round(_swept(spark, sf)["condition_bands"], *_ROUNDED)


@query(_summary_sql("n_states, threshold, label", "(SELECT *, unnest(true_labels) AS label FROM de)", _SWEPT))
def sweep_labels(spark, sf):
    """The same by true label."""
    return _round(_swept(spark, sf)["condition_labels"], *_ROUNDED)


_SEEDS = "rw AS (SELECT l_returnflag AS method, CAST(l_suppkey % 40 AS INTEGER) AS seed, CASE WHEN l_orderkey % 997 = 0 THEN 'missing' WHEN l_orderkey % 1499 = 0 THEN 'invalid' ELSE 'complete' END AS status, CASE WHEN l_orderkey % 997 = 0 OR l_orderkey % 1499 = 0 OR l_partkey % 5003 = 1 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS quantity, CAST(l_discount AS DOUBLE) AS discount FROM lineitem)"


def _seed_rows(spark, sf) -> DataFrame:
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    a, b = F.col("l_orderkey") % 997 == 0, F.col("l_orderkey") % 1499 == 0
    return l.select(F.col("l_returnflag").alias("method"), (F.col("l_suppkey") % 40).cast("int").alias("seed"), F.when(a, "missing").when(b, "invalid").otherwise("complete").alias("status"), F.when(~(a | b | (F.col("l_partkey") % 5003 == 1)), F.col("l_quantity").cast("double")).alias("quantity"), F.col("l_discount").cast("double").alias("discount"))


@query(f"WITH {_SEEDS}, sd AS (SELECT method, seed, count(*) AS r, count(*) FILTER (status = 'complete') AS c, count(*) FILTER (status = 'missing') AS m, count(*) FILTER (status = 'invalid') AS i, bool_and(status = 'complete') AS w, CASE WHEN bool_and(status = 'complete') AND count(quantity) = count(*) THEN avg(quantity) END AS q, CASE WHEN bool_and(status = 'complete') THEN avg(discount) END AS d FROM rw GROUP BY ALL) SELECT method, CAST(sum(r) AS BIGINT) AS expected_runs, CAST(sum(c) AS BIGINT) AS complete_runs, CAST(sum(m) AS BIGINT) AS missing_runs, CAST(sum(i) AS BIGINT) AS invalid_runs, count(*) AS expected_seeds, count(*) FILTER (w) AS complete_seeds, round(avg(q), 6) AS quantity_mean, round(stddev_samp(q), 6) AS quantity_sd, count(q) AS quantity_n_seeds, round(avg(d), 6) AS discount_mean, round(stddev_samp(d), 6) AS discount_sd, count(d) AS discount_n_seeds FROM sd GROUP BY method")
def seed_means(spark, sf):
    """Seeds with a run that is missing or invalid are left out; then means and deviations over seeds."""
    return _round(evaluation.seed_means(_seed_rows(spark, sf), ["method"], ["quantity", "discount"]), "quantity_mean", "quantity_sd", "discount_mean", "discount_sd")


@query("WITH rw AS (SELECT l_returnflag AS method, CAST(l_suppkey % 40 AS INTEGER) AS seed, l_linenumber AS days, avg(CAST(l_quantity AS DOUBLE)) AS q FROM lineitem GROUP BY ALL), bs AS (SELECT method, seed, q AS b FROM rw WHERE days = 4), jn AS (SELECT rw.*, b FROM rw LEFT JOIN bs USING (method, seed)), ev AS (SELECT method, CAST(days AS VARCHAR) AS days, q, b FROM jn UNION ALL SELECT method, NULL, q, b FROM jn) SELECT method, days, count(*) AS n, round(avg(q), 6) AS quantity, round(avg(q - b), 6) AS quantity_delta FROM ev GROUP BY ALL")
def baseline_deltas(spark, sf):
    """Means by number of days and over all, against the same seed's run of four days."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = l.groupBy(F.col("l_returnflag").alias("method"), (F.col("l_suppkey") % 40).cast("int").alias("seed"), F.col("l_linenumber").alias("days")).agg(F.avg(F.col("l_quantity").cast("double")).alias("quantity"))
    return _round(evaluation.baseline_deltas(rows, ["method"], "days", 4, ["quantity"]), "quantity", "quantity_delta")


@query("WITH w AS (SELECT l_orderkey, l_linenumber, l_returnflag AS method, 1.0 / count(*) OVER (PARTITION BY l_orderkey) AS w FROM lineitem) SELECT method, count(*) AS n_rows, round(sum(w), 6) AS weight_sum, count(DISTINCT l_orderkey) AS n_occurrences, round(sum(w) - count(DISTINCT l_orderkey), 6) AS difference, abs(sum(w) - count(DISTINCT l_orderkey)) < 1e-9 AS ok FROM w GROUP BY method")
def weight_audit(spark, sf):
    """Lines weigh one order together; by flag they do not, as orders have lines of several."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    return _round(evaluation.weight_audit(l.withColumnRenamed("l_returnflag", "method"), ["method"], "w", ["l_orderkey"]), "weight_sum", "difference")


@query(f"WITH {EV}, {runs_sql('home, date, band')}, {_grams_sql('home, date, band', 2, 4)} SELECT band, n, count(*) AS n_rows, count(*) FILTER (contains(sequence, 'view')) AS n_viewed, round(count(*) FILTER (contains(sequence, 'view')) / count(*), 6) AS viewed_rate FROM g GROUP BY band, n")
def pattern_breakdown(spark, sf):
    """N-grams of bands by length, and how many of them hold a view."""
    g = _grams(spark, sf).withColumn("viewed", F.contains("sequence", F.lit("view")))
    return _round(evaluation.breakdown(g, ["band", "length"], ["viewed"]), "viewed_rate").withColumnsRenamed({"n": "n_rows", "length": "n"})


def _grams(spark, sf) -> DataFrame:
    """band, sequence, length of every n-gram of two to four states in a day's band."""
    r = sequences.runs(log(spark, sf), ["home", "date", "band"])
    w = Window.partitionBy("home", "date", "band").orderBy("ts", "ord")
    for i in range(1, 4):
        r = r.withColumn(f"s{i}", F.lead("state", i).over(w))
    made = [F.when(F.col(f"s{n - 1}").isNotNull(), F.struct(F.concat_ws(fn.ARROW, "state", *(f"s{i}" for i in range(1, n))).alias("sequence"), F.lit(n).alias("length"))) for n in range(2, 5)]
    return r.select("home", "date", "band", "ts", "k", F.explode(F.array_compact(F.array(*made))).alias("g")).select("home", "date", "band", "ts", "k", "g.*")


@query("WITH x AS (SELECT l_shipdate AS d, l_suppkey, l_linenumber, l_returnflag FROM lineitem) SELECT CAST(d AS DATE)::VARCHAR AS day, l_returnflag AS method, count(*) AS n, count(*) - count(DISTINCT ROW(l_suppkey, l_linenumber)) AS duplicates, CASE WHEN count(*) > 1 THEN round((count(*) - count(DISTINCT ROW(l_suppkey, l_linenumber))) / count(*), 6) END AS duplicate_rate FROM x GROUP BY ALL")
def duplicate_rates(spark, sf):
    """Lines of a day that repeat supplier and line number."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").withColumns({"day": F.to_date("l_shipdate").cast("string"), "method": F.col("l_returnflag")})
    return _round(evaluation.duplicate_rates(l, ["day", "method"], ["l_suppkey", "l_linenumber"]), "duplicate_rate")


@query("WITH c AS (SELECT l_returnflag AS method, CAST(l_suppkey % 5 AS INTEGER) AS run, count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) AS tp, count(*) FILTER (l_quantity > 25 AND l_discount <= 0.05) AS fp, count(*) FILTER (l_quantity <= 25 AND l_discount > 0.05) AS fn FROM lineitem GROUP BY ALL), s AS (SELECT method, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY method) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS jaccard FROM s")
def count_scores(spark, sf):
    """Scores of a method from the summed counts of its runs."""
    p, t = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    c = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("method"), (F.col("l_suppkey") % 5).alias("run")).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return _round(evaluation.count_scores(c, ["method"]), "precision", "recall", "f1", "jaccard")


@query(f"WITH {EV}, {runs_sql('home, date, band')}, {_grams_sql('home, date, band', 2, 4)}, c AS (SELECT band, n, count(*) AS c FROM g GROUP BY band, n), l AS (SELECT band, CAST(sum(c) AS BIGINT) AS n, '{{' || string_agg('\"' || n || '\":' || c, ',' ORDER BY n) || '}}' AS lengths FROM c GROUP BY band) SELECT l.band, l.n, lengths, u.n_unique FROM l JOIN (SELECT band, count(DISTINCT sequence) AS n_unique FROM g GROUP BY band) AS u USING (band)")
def length_distribution(spark, sf):
    """How many n-grams of each length a band has, as JSON, and how many different ones."""
    return evaluation.length_distribution(_grams(spark, sf), ["band"])


_COSTS = "e AS (SELECT 'm' || (conv_id % 4) AS model, 'e' || (turn % 3) AS evaluation, role AS method, CASE WHEN turn % 3 = 2 THEN 0 ELSE 1 END AS requests, strlen(text) AS a, strlen(role) AS b FROM conversations), p(model, i, o) AS (VALUES ('m0', 2.5, 10.0), ('m1', 0.15, 0.6), ('m2', 3.0, 15.0)), r AS (SELECT e.*, i, o, a * i / 1000000 + b * o / 1000000 AS cost FROM e LEFT JOIN p USING (model)), v AS (SELECT * FROM r UNION ALL SELECT model, NULL, method, requests, a, b, i, o, cost FROM r)"


@query(f"WITH {_COSTS} SELECT model, evaluation, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(a) AS BIGINT) AS input_tokens, CAST(sum(b) AS BIGINT) AS output_tokens, CASE WHEN NOT bool_or(i IS NULL) THEN round(CAST(sum(cost) AS DOUBLE) * 1000000, 2) END AS micro_usd, string_agg(DISTINCT method, '; ' ORDER BY method) AS methods, CASE WHEN bool_or(i IS NULL) THEN 'no price for ' || model END AS error FROM v GROUP BY model, evaluation")
def cost_report(spark, sf):
    """Requests, tokens and cost of each evaluation and of each model; one model has no price."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = c.select(F.concat(F.lit("m"), F.col("conv_id") % 4).alias("model"), F.concat(F.lit("e"), F.col("turn") % 3).alias("evaluation"), F.col("role").alias("method"), F.when(F.col("turn") % 3 == 2, 0).otherwise(1).alias("requests"), F.octet_length("text").alias("input_tokens"), F.octet_length("role").alias("output_tokens"))
    prices = spark.createDataFrame([("m0", 2.5, 10.0), ("m1", 0.15, 0.6), ("m2", 3.0, 15.0)], "model string, input_usd double, output_usd double")
    return evaluation.cost_report(rows, prices).withColumn("micro_usd", F.round(F.col("cost").cast("double") * 1000000, 2)).drop("cost")


@query("WITH x AS (SELECT c_custkey, c_mktsegment FROM customer), r AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT x.c_custkey, CASE WHEN r.c_custkey IS NULL THEN 'missing' WHEN n_orders < 3 THEN 'invalid' ELSE 'complete' END AS status, CASE WHEN n_orders >= 3 THEN n_orders END AS n_orders FROM x LEFT JOIN r USING (c_custkey)")
def run_status(spark, sf):
    """Every customer with the state of its orders: none, too few, complete."""
    x = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey")
    r = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return evaluation.with_status(x, r, ["c_custkey"], ["n_orders"], F.col("n_orders") >= 3)


# Splits and joins -------------------------------------------------------------------------------------------------------


@query(f"WITH {EV}, {runs_sql('home, band')} SELECT home, band, ts, ord, state FROM r")
def band_series(spark, sf):
    """The states of each band by itself, runs as one."""
    return sequences.by_band(log(spark, sf), ["home"]).select("home", "band", "ts", "ord", "state")


_EDGES = "x AS (SELECT home, state, start_time, end_time, unnest(list_concat(list_concat([start_time], list_filter(list_transform(range(0, (date_diff('day', start_time, end_time) + 1) * 4), lambda i: CAST(CAST(start_time AS DATE) AS TIMESTAMP) + to_days(CAST(i // 4 AS INTEGER)) + to_hours(([0, 6, 10, 18])[i % 4 + 1])), lambda t: t > start_time AND t < end_time)), [])) AS a FROM iv)"


@query(f"WITH {_IV}, {_EDGES}, p AS (SELECT home, state, a AS start_time, coalesce(lead(a) OVER (PARTITION BY home, start_time, end_time, state ORDER BY a), end_time) AS end_time FROM x), b AS (SELECT *, CAST(start_time AS DATE) AS date, {_BAND.format(t='start_time')} AS band FROM p), m AS (SELECT *, sum(CASE WHEN ps = state AND pe = start_time THEN 0 ELSE 1 END) OVER (PARTITION BY home, date, band ORDER BY start_time ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(state) OVER w AS ps, lag(end_time) OVER w AS pe FROM b WINDOW w AS (PARTITION BY home, date, band ORDER BY start_time))) SELECT home, CAST(date AS VARCHAR) AS date, band, state, min(start_time) AS start_time, max(end_time) AS end_time FROM m GROUP BY home, m.date, band, state, run")
def band_pieces(spark, sf):
    """Intervals cut at midnights and band edges."""
    out = intervals.split_at_bands(sequences.intervals(log(spark, sf), ["home"]), ["home"])
    return out.withColumn("date", F.col("date").cast("string")).select("home", "date", "band", "state", "start_time", "end_time")


@query(f"WITH {INTERVAL_TABLES}, mp AS (SELECT category, CASE WHEN category IN ('Work', 'Bathing') THEN 'Unmapped' ELSE upper(category) END AS to_ FROM (SELECT DISTINCT category FROM tr)) SELECT home, pr.category AS pattern_id, mp.to_ AS category, start_time, end_time FROM pr JOIN mp ON pr.category = mp.category WHERE to_ <> 'Unmapped'")
def mapped_predictions(spark, sf):
    """Occurrences with their pattern's category; unmapped patterns are left out."""
    e = log(spark, sf)
    mapping = truths(e).select(F.col("category").alias("pattern_id")).distinct().withColumn("category", F.when(F.col("pattern_id").isin("Work", "Bathing"), "Unmapped").otherwise(F.upper("pattern_id")))
    return intervals.mapped_predictions(predictions(e).select("home", F.col("category").alias("pattern_id"), "start_time", "end_time"), mapping, ["pattern_id"]).select("home", "pattern_id", "category", "start_time", "end_time")


@query(f"WITH {EV} SELECT DISTINCT home, state, k FROM ev AS a WHERE ts >= TIMESTAMP '{SPLIT}' AND NOT EXISTS (SELECT 1 FROM ev AS b WHERE b.ts < TIMESTAMP '{SPLIT}' AND a.home = b.home AND a.state = b.state AND a.k = b.k)")
def unseen(spark, sf):
    """States of a home after the split that it never had before."""
    e, split = log(spark, sf), F.lit(SPLIT).cast("timestamp_ntz")
    return intervals.unseen(e.filter(F.col("ts") >= split), e.filter(F.col("ts") < split), ["home", "state", "k"])


@query(f"WITH {EV}, a AS (SELECT home, date, ts, row_number() OVER (PARTITION BY home, date ORDER BY ts, ord) AS nth FROM ev WHERE sensor = 'view'), b AS (SELECT home, date, ts, row_number() OVER (PARTITION BY home, date ORDER BY ts, ord) AS nth FROM ev WHERE sensor = 'purchase') SELECT home, CAST(date AS VARCHAR) AS date, CAST(nth AS INTEGER) AS nth, a.ts, b.ts AS actual_ts FROM a LEFT JOIN b USING (home, date, nth)")
def by_position(spark, sf):
    """Each view of a day with the purchase of the same number."""
    e = log(spark, sf).select("home", "date", "ts", "ord", "sensor")
    out = intervals.by_position(e.filter("sensor = 'view'"), e.filter("sensor = 'purchase'"), ["home", "date"], ["ts", "ord"])
    return out.select("home", F.col("date").cast("string").alias("date"), "nth", "ts", "actual_ts")


@query(f"WITH {INTERVAL_TABLES}, al(label, extra) AS (VALUES ('SLEEPING', ['Wake_Up']), ('Eating', ['Meal_Preparation', 'Eating'])), x AS (SELECT home, ord, unnest(list_distinct(list_concat(coalesce(extra, []), [category]))) AS category FROM tr LEFT JOIN al ON lower(category) = lower(al.label)) SELECT home, ord, category FROM x")
def expanded_intervals(spark, sf):
    """Label intervals once for each category of their label."""
    also = spark.createDataFrame([("SLEEPING", ["Wake_Up"]), ("Eating", ["Meal_Preparation", "Eating"])], "label string, categories array<string>")
    return intervals.expanded(truths(log(spark, sf)).withColumn("label", F.col("category")), also).select("home", "ord", "category")


# Labels, records, catalogs ----------------------------------------------------------------------------------------------

_RAW = "CASE c_custkey % 7 WHEN 0 THEN 'sleep; Wake_up' WHEN 1 THEN '[\"Meal\", \"wake up\"]' WHEN 2 THEN 'WORK|napping' WHEN 3 THEN '' WHEN 4 THEN 'Relax, relax , MEAL' WHEN 5 THEN 'House/work' ELSE NULL END"
_KEYED = "lower(trim(translate(x, '-_/', '   ')))"
_CANON = f"CASE {_KEYED} WHEN 'sleep' THEN 'Sleep' WHEN 'wakeup' THEN 'Wake-up' WHEN 'wake up' THEN 'Wake-up' WHEN 'meal' THEN 'Meal' WHEN 'relax' THEN 'Relax' WHEN 'outing' THEN 'Outing' WHEN 'hygiene' THEN 'Hygiene' WHEN 'toileting' THEN 'Toileting' WHEN 'housework' THEN 'Housework' WHEN 'work' THEN 'Work' WHEN 'other' THEN 'Other' END"


@query(f"WITH r AS (SELECT c_custkey, {_RAW} AS raw FROM customer), v AS (SELECT c_custkey, raw, CASE WHEN raw LIKE '[%' THEN CAST(json_extract_string(raw, '$[*]') AS VARCHAR[]) WHEN contains(raw, ';') THEN string_split(raw, ';') WHEN contains(raw, '|') THEN string_split(raw, '|') WHEN contains(raw, ',') THEN string_split(raw, ',') WHEN contains(raw, '/') THEN string_split(raw, '/') WHEN trim(raw) <> '' THEN [raw] ELSE [] END AS held FROM r), h AS (SELECT c_custkey, list_transform(held, lambda x: trim(x)) AS held FROM v), l AS (SELECT c_custkey, held, list_sort(list_distinct(list_filter(list_transform(held, lambda x: {_CANON}), lambda x: x IS NOT NULL))) AS labels, list_filter(held, lambda x: {_CANON} IS NULL) AS unknown FROM h) SELECT c_custkey, array_to_string(coalesce(labels, []), ';') AS labels, array_to_string(coalesce(unknown, []), ';') AS unknown, CASE WHEN coalesce(len(held), 0) = 0 THEN 'missing' WHEN len(unknown) > 0 THEN 'unknown' ELSE 'valid' END AS status FROM l")
def normalised_labels(spark, sf):
    """Raw label texts as sets of known labels."""
    c = F.col("c_custkey") % 7
    raw = F.when(c == 0, "sleep; Wake_up").when(c == 1, '["Meal", "wake up"]').when(c == 2, "WORK|napping").when(c == 3, "").when(c == 4, "Relax, relax , MEAL").when(c == 5, "House/work")
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", fn.label_values(raw).alias("held"))
    s = fn.label_sets(F.col("held"))
    return rows.select("c_custkey", F.array_join(s["labels"], ";").alias("labels"), F.array_join(s["unknown"], ";").alias("unknown"), s["status"].alias("status"))


@query(f"WITH {EV}, {runs_sql('home, date, band')}, {_grams_sql('home, date, band', 2, 4)} SELECT DISTINCT sequence FROM g WHERE NOT contains(sequence, '{OTHER}') AND (len(string_split(sequence, '->')) < 4 OR string_split(sequence, '->')[1:2] <> string_split(sequence, '->')[3:4])")
def valid_sequences(spark, sf):
    """Different n-grams that a synthetic pattern may have."""
    g = _grams(spark, sf).select("sequence").distinct()
    return g.filter(fn.valid_sequence(F.split("sequence", fn.ARROW)))


@query("WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS name, o_orderstatus AS band, list_transform(range(0, o_orderkey % 6), lambda i: 's' || ((o_custkey + i) % 9)) AS states, CASE o_custkey % 5 WHEN 0 THEN ['Meal'] WHEN 1 THEN [] WHEN 2 THEN ['Meal', 'nothing'] ELSE ['Relax', 'Work'] END AS labels FROM orders), k AS (SELECT * FROM r WHERE trim(name) <> '' AND len(states) BETWEEN 2 AND 4 AND len(labels) > 0 AND NOT list_contains(labels, 'nothing')) SELECT band, array_to_string(states, '->') AS sequence, min(o_orderkey) AS o_orderkey FROM k GROUP BY band, states")
def strict_records(spark, sf):
    """Records with all that is asked for, the first of each band and sequence."""
    o, c = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_custkey") % 5
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.col("o_orderpriority")).alias("name"), F.lit("reason").alias("reason"), F.col("o_orderstatus").alias("band"), F.expr("transform(slice(array(0, 1, 2, 3, 4), 1, CAST(o_orderkey % 6 AS INT)), i -> concat('s', CAST((o_custkey + i) % 9 AS STRING)))").alias("states"), F.when(c == 0, F.array(F.lit("Meal"))).when(c == 1, F.array().cast("array<string>")).when(c == 2, F.array(F.lit("Meal"), F.lit("nothing"))).otherwise(F.array(F.lit("Relax"), F.lit("Work"))).alias("labels"))
    out = evaluation.strict_records(rows, ["o_orderkey"], fn.EVALUATED)
    return out.select("band", F.array_join("states", fn.ARROW).alias("sequence"), "o_orderkey")


_CATALOG = f"{EV}, {runs_sql('home, date, band')}, {_grams_sql('home, date, band', 2, 4)}, su AS (SELECT home AS target, band, sequence, n, count(DISTINCT home || '|' || date) AS support FROM g GROUP BY ALL HAVING count(DISTINCT home || '|' || date) >= 2), ca AS (SELECT * FROM su QUALIFY rank() OVER (PARTITION BY target, band ORDER BY support DESC, n DESC) = 1)"


def _catalog(spark, sf):
    g = _grams(spark, sf).withColumns({"target": F.col("home"), "episode": F.concat_ws("|", "home", "date")})
    return evaluation.gold_catalog(g.groupBy("target", "band", "episode").agg(F.collect_set("sequence").alias("sequences")), "target", 2)


@query(f"WITH {_CATALOG} SELECT target, band, sequence, support FROM ca")
def gold_catalog(spark, sf):
    """The sequence that most episodes of a target and band have, the longest of them."""
    return _catalog(spark, sf)[0].select("target", "band", "sequence", "support")


@query(f"WITH {_CATALOG} SELECT su.target, su.band, su.sequence, su.support FROM su WHERE EXISTS (SELECT 1 FROM ca WHERE ca.target = su.target AND ca.band = su.band AND ca.n > su.n AND contains('->' || ca.sequence || '->', '->' || su.sequence || '->')) AND NOT EXISTS (SELECT 1 FROM ca WHERE ca.target = su.target AND ca.band = su.band AND ca.sequence = su.sequence)")
def catalog_fragments(spark, sf):
    """Supported parts of canonical sequences."""
    return _catalog(spark, sf)[1].select("target", "band", "sequence", "support")


@query(f"WITH {EV}, {runs_sql('home, date, band')}, {_grams_sql('home, date, band', 2, 4)} SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, band, sequence) AS INTEGER) AS rank, band, sequence, count(*) AS support FROM g GROUP BY band, sequence HAVING count(*) >= 2 ORDER BY rank LIMIT 25")
def frequency_baseline(spark, sf):
    """The 25 most frequent sequences of bands."""
    return evaluation.frequency_baseline(_grams(spark, sf), 2, 25)



# Quality ----------------------------------------------------------------------------------------------------------------

_ISLANDS = "SELECT {k}, sum((epoch_us(e) - epoch_us(s)) / 1e6) AS x FROM (SELECT {k}, isl, min(a) AS s, max(b) AS e FROM (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, max(b) OVER (PARTITION BY {k} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {t})) GROUP BY {k}, isl) GROUP BY {k}"
_QUALITY = f"""{_IV.replace(f'{EV},', f'{INTERVAL_TABLES},', 1)}, {_span_grams(4)}, oc AS (
  SELECT row_number() OVER () AS id, {_BAND.format(t='start_time')} AS band, sequence, home, start_time, end_time, start_time < TIMESTAMP '{SPLIT}' AS train FROM g
), ov AS (
  SELECT id, band, sequence, train, category, greatest(oc.start_time, tr.start_time) AS a, least(oc.end_time, tr.end_time) AS b FROM oc JOIN tr ON oc.home = tr.home AND oc.start_time < tr.end_time AND tr.start_time < oc.end_time
), lb AS (
  SELECT band, sequence, list(category) AS labels FROM (SELECT *, sum(s) OVER (PARTITION BY band, sequence) AS total FROM (SELECT band, sequence, category, sum((epoch_us(b) - epoch_us(a)) / 1e6) AS s FROM ov WHERE train GROUP BY ALL)) WHERE s >= 0.2 * total GROUP BY band, sequence
), an AS (SELECT * FROM ov WHERE NOT train), ow AS (SELECT an.* FROM an JOIN lb USING (band, sequence) WHERE list_contains(labels, category)),
ua AS ({_ISLANDS.format(k='id', t='an')}), uo AS ({_ISLANDS.format(k='id', t='ow')}), sh AS (
  SELECT band, sequence, count(*) FILTER (train) AS tr, count(*) FILTER (NOT train) AS te, count(*) FILTER (NOT train AND uo.x >= 60) / nullif(count(*) FILTER (NOT train), 0) AS hit, count(*) FILTER (NOT train AND ua.x >= 60) / nullif(count(*) FILTER (NOT train), 0) AS ah,
    coalesce(sum(uo.x), 0) / nullif(sum((epoch_us(end_time) - epoch_us(start_time)) / 1e6) FILTER (NOT train), 0) AS pu, coalesce(sum(ua.x), 0) / nullif(sum((epoch_us(end_time) - epoch_us(start_time)) / 1e6) FILTER (NOT train), 0) AS ap
  FROM oc LEFT JOIN ua USING (id) LEFT JOIN uo USING (id) GROUP BY band, sequence
), q AS (
  SELECT *, string_split(sequence, '->') AS x, tr > 0 AND te > 0 AS c FROM sh
), fl AS (
  SELECT *, len(x) = 2 AS fr, {_SELF} AS tw, {_TRIP} AS bt, {_LOOP} AS lo FROM q
), qa AS (
  SELECT band, sequence, hit, pu, c, c AND (hit >= 0.05 OR pu >= 0.01) AS g, c AND ah < 0.1 AND ap < 0.02 AS la, c AND bt AS b, c AND lo AS l, c AND (tw OR bt OR lo) AS st, c AND fr AS fr FROM fl
)"""


def _flagged(spark, sf) -> DataFrame:
    e, split, by = log(spark, sf), F.lit(SPLIT).cast("timestamp_ntz"), ["band", "sequence"]
    held = stored(_spans_ahead(sequences.intervals(e, ["home"])))  # read for training and for the test
    occ = _spans_of(held).withColumn("band", fn.time_band("start_time"))
    train, test, t = occ.filter(F.col("start_time") < split), occ.filter(F.col("start_time") >= split), truths(e).drop("ord")
    met = intervals.overlap_join(train.select(*by, "home", "start_time", "end_time"), t, ["home"]).withColumnRenamed("b_category", "category")
    shares = patterns.truth_shares(test, t, scoring.true_sets(met, by, 0.2), ["home"], by, least_seconds=60.0)
    rows = train.groupBy(*by).agg(F.count(F.lit(1)).alias("train_support")).join(shares, by, "full").fillna(0, ["train_support", "test_support"])
    return patterns.quality(rows.withColumn("fragmented", (F.size(F.split("sequence", fn.ARROW)) == 2).cast("int")), [OTHER], (0.05, 0.01), (0.1, 0.02))


def _spans_ahead(held: DataFrame) -> DataFrame:
    """home, start_time, state, and states and ends of the three intervals behind."""
    w = Window.partitionBy("home").orderBy("start_time", "ord")
    ahead = {f"{c}{i}": F.lead(x, i).over(w) for i in range(1, 4) for c, x in (("s", "state"), ("e", "end_time"))}
    return held.withColumns(ahead).select("home", "start_time", "state", *ahead)


def _spans_of(rows: DataFrame) -> DataFrame:
    """home, start_time, end_time, sequence of two to four intervals in a row."""
    made = [F.when(F.col(f"s{n - 1}").isNotNull(), F.struct(F.concat_ws(fn.ARROW, "state", *(f"s{i}" for i in range(1, n))).alias("sequence"), F.col(f"e{n - 1}").alias("end_time"))) for n in range(2, 5)]
    return rows.select("home", "start_time", F.explode(F.array_compact(F.array(*made))).alias("g")).select("home", "start_time", "g.*")


@query(f"WITH {_QUALITY} SELECT band, sequence, round(hit, 6) AS hit_rate, round(pu, 6) AS purity, CAST(c AS INTEGER) AS counted, CAST(g AS INTEGER) AS grounded, CAST(la AS INTEGER) AS useless_a, CAST(b AS INTEGER) AS useless_b, CAST(l AS INTEGER) AS useless_c, CAST(la OR b OR l AS INTEGER) AS useless, CAST(st AS INTEGER) AS structural, CAST(st OR la AS INTEGER) AS contextless, CAST(fr AS INTEGER) AS fragment, CAST(g AND NOT st AND NOT fr AS INTEGER) AS useful FROM qa")
def pattern_quality(spark, sf):
    """Which sequences of bands are grounded, useless, broken off or useful."""
    return _round(_flagged(spark, sf), "hit_rate", "purity").select("band", "sequence", "hit_rate", "purity", "counted", "grounded", "useless_a", "useless_b", "useless_c", "useless", "structural", "contextless", "fragment", "useful")


@query(f"WITH {_QUALITY} SELECT band, count(*) AS n_patterns, count(*) FILTER (c) AS n_counted, {', '.join(f'round(coalesce(count(*) FILTER ({x}) / nullif(count(*) FILTER (c), 0), 0), 6) AS {n}_rate' for n, x in {'grounded': 'g', 'useless': 'la OR b OR l', 'contextless': 'st OR la', 'structural': 'st', 'fragment': 'fr', 'useful': 'g AND NOT st AND NOT fr'}.items())} FROM qa GROUP BY band")
def quality_rates(spark, sf):
    """The shares of these flags in each band."""
    return _round(patterns.quality_rates(_flagged(spark, sf), ["band"]), "grounded_rate", "useless_rate", "contextless_rate", "structural_rate", "fragment_rate", "useful_rate")


@query(f"WITH {EV}, {runs_sql('home, date, band')}, {_grams_sql('home, date, band', 2, 4)}, u AS (SELECT band, sequence, max(CAST(ts >= TIMESTAMP '{SPLIT}' AS INTEGER)) AS p, max(CAST(k = 3 AS INTEGER)) AS t FROM g GROUP BY band, sequence) SELECT band, count(*) FILTER (p = 1 AND t = 1) AS tp, count(*) FILTER (p = 1 AND t = 0) AS fp, count(*) FILTER (p = 0 AND t = 1) AS fn, count(*) FILTER (p = 0 AND t = 0) AS tn FROM u GROUP BY band")
def confusion(spark, sf):
    """Sequences after the split against those that begin with k = 3, over all sequences of a band."""
    g, split = _grams(spark, sf), F.lit(SPLIT).cast("timestamp_ntz")
    return scoring.confusion(g.filter(F.col("ts") >= split), g.filter("k = 3"), g, ["sequence"], ["band"])


@query(f"WITH {EV}, s AS (SELECT home, min(ts) AS a, max(ts) AS b FROM ev GROUP BY home) SELECT home, a + to_microseconds(CAST(floor((epoch_us(b) - epoch_us(a)) * 0.7) AS BIGINT)) AS split FROM s")
def split_instants(spark, sf):
    """Seven tenths of each home's span of time."""
    return patterns.split_at(log(spark, sf), ["home"], ratio=0.7)


@query(f"WITH {EV}, s AS (SELECT home, min(ts) AS a FROM ev GROUP BY home) SELECT home, CAST(CAST(a AS DATE) + 21 AS TIMESTAMP) AS split FROM s")
def split_after_days(spark, sf):
    """The midnight 21 days after each home's first day."""
    return patterns.split_at(log(spark, sf), ["home"], days=21)


@query(f"WITH {INTERVAL_TABLES}, pu AS (SELECT home, category, min(start_time) AS s, max(end_time) AS e FROM (SELECT *, sum(CASE WHEN r IS NULL OR start_time > r THEN 1 ELSE 0 END) OVER (PARTITION BY home, category ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, max(end_time) OVER (PARTITION BY home, category ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM pr)) GROUP BY home, category, isl), tu AS (SELECT home, category, min(start_time) AS s, max(end_time) AS e FROM (SELECT *, sum(CASE WHEN r IS NULL OR start_time > r THEN 1 ELSE 0 END) OVER (PARTITION BY home, category ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, max(end_time) OVER (PARTITION BY home, category ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM tr)) GROUP BY home, category, isl), sh AS (SELECT pu.category, sum((epoch_us(least(pu.e, tu.e)) - epoch_us(greatest(pu.s, tu.s))) / 1e6) AS tp FROM pu JOIN tu ON pu.home = tu.home AND pu.category = tu.category AND pu.s < tu.e AND tu.s < pu.e GROUP BY pu.category), a AS (SELECT category, sum((epoch_us(e) - epoch_us(s)) / 1e6) AS p FROM pu GROUP BY category), b AS (SELECT category, sum((epoch_us(e) - epoch_us(s)) / 1e6) AS t FROM tu GROUP BY category) SELECT category, round(coalesce(tp, 0), 3) AS tp, round(coalesce(p, 0), 3) AS predicted, round(coalesce(t, 0), 3) AS true_seconds, round(coalesce(2 * tp / (p + t), 0), 6) AS f1 FROM a FULL JOIN b USING (category) LEFT JOIN sh USING (category)")
def weighted_seconds(spark, sf):
    """Predicted, true and shared seconds of each category."""
    e = log(spark, sf)
    out = intervals.category_seconds(predictions(e).drop("ord"), truths(e).drop("ord"), ["home"]).withColumnRenamed("true", "true_seconds")
    return _round(_round(out.select("category", "tp", "predicted", "true_seconds", "f1"), "f1"), "tp", "predicted", "true_seconds", digits=3)
