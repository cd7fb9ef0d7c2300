"""One query for each operator over the driver's tables, with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog import functions as fn
from lumenlog.functions import OTHER
from lumenlog.operators import faults, intervals, scoring, sequences, sinks, stats, vectors
from lumenlog.plans.adapter import EV, INTERVAL_TABLES, SENSORS, SPLIT, log, predictions, runs_sql, truths

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _round(rows: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({n: F.round(n, digits) for n in names})


# Networks ---------------------------------------------------------------------------------------------------------------

_STEPS = "n AS (SELECT *, lead(state) OVER (PARTITION BY {keys} ORDER BY ts, ord) AS nx FROM r)"
_TRANSITIONS = "c AS (SELECT {by}, state AS src, nx AS dst, count(*) AS cnt FROM n WHERE nx IS NOT NULL GROUP BY ALL)"


@query(f"WITH {EV}, {runs_sql('home, band')}, {_STEPS.format(keys='home, band')}, {_TRANSITIONS.format(by='band')} SELECT band, src, dst, cnt, round(cnt / sum(cnt) OVER (PARTITION BY band, src), 6) AS prob FROM c")
def transition_network(spark, sf):
    """Transitions of each band; a home's days follow each other without a break."""
    return _round(sequences.transitions(log(spark, sf), ["home", "band"], ["band"]), "prob")


@query(f"WITH {EV}, {runs_sql('home, date, band')}, {_STEPS.format(keys='home, date, band')}, {_TRANSITIONS.format(by='band')} SELECT band, src, dst, cnt, round(cnt / sum(cnt) OVER (PARTITION BY band, src), 6) AS prob FROM c")
def segment_network(spark, sf):
    """Transitions that never leave a day's band."""
    return _round(sequences.transitions(log(spark, sf), ["home", "date", "band"], ["band"]), "prob")


@query(f"WITH {EV}, {runs_sql('home')}, {_STEPS.format(keys='home')}, c AS (SELECT state AS src, nx AS dst, count(*) AS cnt FROM n WHERE nx IS NOT NULL GROUP BY ALL) SELECT src, dst, cnt, round(cnt / sum(cnt) OVER (PARTITION BY src), 6) AS prob FROM c WHERE src <> '{OTHER}' AND dst <> '{OTHER}' QUALIFY cnt / sum(cnt) OVER (PARTITION BY src) >= 0.2")
def filtered_edges(spark, sf):
    """Edges of at least 0.2 without the unmapped state; chances are over what is left of a source."""
    return _round(sequences.filtered_edges(sequences.transitions(log(spark, sf), ["home"], []), [], 0.2, [OTHER]), "prob")


@query(f"WITH {EV}, {runs_sql('home')} SELECT home, ts, ord, state FROM r")
def state_runs(spark, sf):
    return sequences.runs(log(spark, sf), ["home"]).select("home", "ts", "ord", "state")


@query(f"WITH {EV}, d AS (SELECT band, state, coalesce((epoch_us(lead(ts) OVER (PARTITION BY home, band ORDER BY ts, ord)) - epoch_us(ts)) / 1e6, 1.0) AS s FROM ev) SELECT band, state, round(sum(s), 3) AS seconds, count(*) AS n_rows FROM d GROUP BY ALL")
def state_durations(spark, sf):
    return _round(sequences.durations(log(spark, sf), ["home", "band"], ["band"]), "seconds", digits=3)


_INTERVALS = "iv AS (SELECT home, start_time, end_time, state, ord FROM (SELECT home, ts AS start_time, coalesce(lead(ts) OVER (PARTITION BY home ORDER BY ts, ord), last_ts) AS end_time, state, ord FROM (SELECT r.*, m.last_ts FROM r JOIN (SELECT home, max(ts) AS last_ts FROM ev GROUP BY home) AS m USING (home))) WHERE end_time > start_time)"
_IV = f"{EV}, {runs_sql('home')}, {_INTERVALS}"


@query(f"WITH {_IV} SELECT home, start_time, end_time, state FROM iv")
def state_intervals(spark, sf):
    return sequences.intervals(log(spark, sf), ["home"]).drop("ord")


@query(f"WITH {_IV} SELECT home, greatest(start_time, TIMESTAMP '2024-01-08') AS start_time, least(end_time, TIMESTAMP '{SPLIT}') AS end_time, state FROM iv WHERE end_time > TIMESTAMP '2024-01-08' AND start_time < TIMESTAMP '{SPLIT}'")
def clipped_intervals(spark, sf):
    return intervals.clip(sequences.intervals(log(spark, sf), ["home"]).drop("ord"), "2024-01-08", SPLIT)


@query(f"WITH {_IV} SELECT home, start_time, end_time, state FROM iv WHERE end_time > TIMESTAMP '2024-01-08' AND start_time < TIMESTAMP '{SPLIT}'")
def period_intervals(spark, sf):
    return intervals.overlapping(sequences.intervals(log(spark, sf), ["home"]).drop("ord"), "2024-01-08", SPLIT)


@query(f"WITH {EV}, f AS (SELECT home, min(date_trunc('day', ts)) AS d0 FROM ev GROUP BY home) SELECT home, count(*) AS n_events FROM ev JOIN f USING (home) WHERE ts < d0 + INTERVAL 7 DAY GROUP BY home")
def first_days(spark, sf):
    """Events of the first seven calendar days of each home."""
    return intervals.first_days(log(spark, sf), ["home"], 7).groupBy("home").agg(F.count(F.lit(1)).alias("n_events"))


_NET = f"{EV}, {runs_sql('home, band')}, {_STEPS.format(keys='home, band')}, {_TRANSITIONS.format(by='band')}, e AS (SELECT band, src, dst, cnt / sum(cnt) OVER (PARTITION BY band, src) AS prob FROM c)"


@query(f"WITH {_NET}, s AS (SELECT band, count(DISTINCT s) AS n_states FROM (SELECT band, src AS s FROM e UNION ALL SELECT band, dst FROM e) GROUP BY band), g AS (SELECT e.band, count(*) AS n_edges, count(b.src) AS rev FROM e LEFT JOIN e AS b ON e.band = b.band AND e.src = b.dst AND e.dst = b.src GROUP BY e.band), h AS (SELECT band, avg(h) AS mean_entropy FROM (SELECT band, src, -sum(prob * log2(prob)) AS h FROM e GROUP BY ALL) GROUP BY band) SELECT band, n_states, n_edges, round(n_edges / (n_states * (n_states - 1)), 6) AS density, round(rev / n_edges, 6) AS reversible_ratio, round(mean_entropy, 6) AS mean_entropy FROM s JOIN g USING (band) JOIN h USING (band)")
def network_summary(spark, sf):
    e = sequences.transitions(log(spark, sf), ["home", "band"], ["band"])
    return _round(stats.network_summary(e, ["band"]), "density", "reversible_ratio", "mean_entropy")


# Mining -----------------------------------------------------------------------------------------------------------------


def _grams_sql(keys: str, least: int, most: int, source: str = "r") -> str:
    ahead = ", ".join(f"lead(state, {i}) OVER w AS s{i}" for i in range(1, most))
    parts = []
    for n in range(least, most + 1):
        text = " || '->' || ".join(["state", *(f"s{i}" for i in range(1, n))])
        parts.append(f"SELECT *, {n} AS n, {text} AS sequence FROM a" + (f" WHERE s{n - 1} IS NOT NULL" if n > 1 else ""))
    return f"a AS (SELECT *, {ahead} FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY ts, ord)), g AS ({' UNION ALL '.join(parts)})"


@query(f"WITH {EV}, {runs_sql('home')}, {_grams_sql('home', 2, 4)}, t AS (SELECT sequence, n, count(*) AS cnt, min(ROW(ts, ord)) AS f FROM g GROUP BY ALL) SELECT sequence, n, cnt FROM t ORDER BY cnt DESC, n, f, sequence LIMIT 50")
def frequent_sequences(spark, sf):
    """The fifty most frequent n-grams of runs."""
    return sequences.top_patterns(sequences.ngram_counts(log(spark, sf), ["home"], []), [], 50).select("sequence", "n", "cnt")


@query(f"WITH {EV}, {runs_sql('home, date, band')}, {_grams_sql('home, date, band', 2, 4)}, t AS (SELECT band, sequence, n, count(*) AS cnt, min(ROW(ts, ord)) AS f FROM g WHERE NOT contains(sequence, '{OTHER}') GROUP BY ALL HAVING count(*) >= 3) SELECT band, sequence, n, cnt, CAST(row_number() OVER (PARTITION BY band ORDER BY cnt DESC, n, f, sequence) AS INTEGER) AS rank FROM t QUALIFY rank <= 20")
def band_patterns(spark, sf):
    """The twenty most frequent n-grams of each band's segments, three occurrences at least, without the unmapped state."""
    counts = sequences.ngram_counts(log(spark, sf), ["home", "date", "band"], ["band"]).filter((F.col("cnt") >= 3) & ~F.contains("sequence", F.lit(OTHER)))
    return sequences.top_patterns(counts, ["band"], 20).select("band", "sequence", "n", "cnt", "rank")


_SEQ = "string_split(sequence, '->')"
_EXISTS = "len(list_filter(range(1, len(x) - {off} + 1), lambda i: {test})) > 0"
_SELF = _EXISTS.format(off=1, test="x[i] = x[i + 1]")
_BACK = _EXISTS.format(off=2, test="x[i] = x[i + 2]")
_LOOP = _EXISTS.format(off=3, test="x[i] = x[i + 2] AND x[i + 1] = x[i + 3] AND x[i] <> x[i + 1]")
_TRIP = _EXISTS.format(off=2, test=f"x[i] = x[i + 2] AND x[i + 1] = '{OTHER}' AND x[i] <> '{OTHER}'")


@query(f"WITH {EV}, {runs_sql('home')}, {_grams_sql('home', 2, 4)}, t AS (SELECT sequence, count(*) AS cnt, {_SEQ} AS x FROM g GROUP BY sequence) SELECT sequence, cnt, CAST(NOT list_contains(x, '{OTHER}') AS INTEGER) AS light, CAST(NOT list_contains(x, '{OTHER}') AND NOT ({_BACK}) AND NOT ({_LOOP}) AS INTEGER) AS medium, CAST(NOT list_contains(x, '{OTHER}') AND NOT ({_BACK}) AND NOT ({_LOOP}) AND len(list_distinct(x)) = len(x) AS INTEGER) AS strong, CAST({_SELF} AS INTEGER) AS self_transition, CAST({_TRIP} AS INTEGER) AS other_round_trip, CAST({_LOOP} AS INTEGER) AS alternating_loop FROM t")
def rule_filters(spark, sf):
    s = sequences.ngram_counts(log(spark, sf), ["home"], []).withColumn("x", F.split("sequence", fn.ARROW))
    flags = {"light": fn.keep_light("x", [OTHER]), "medium": fn.keep_medium("x", [OTHER]), "strong": fn.keep_strong("x", [OTHER]), "self_transition": fn.self_transition("x"), "other_round_trip": fn.other_round_trip("x", [OTHER]), "alternating_loop": fn.alternating_loop("x")}
    return s.select("sequence", "cnt", *(c.cast("int").alias(n) for n, c in flags.items()))


def _span_grams(most: int) -> str:
    ahead = ", ".join(f"lead(state, {i}) OVER w AS s{i}, lead(end_time, {i}) OVER w AS e{i}" for i in range(1, most))
    parts = [f"SELECT home, start_time, {' || chr(45) || chr(62) || '.join(['state', *(f's{i}' for i in range(1, n))])} AS sequence, e{n - 1} AS end_time FROM a WHERE s{n - 1} IS NOT NULL" for n in range(2, most + 1)]
    return f"a AS (SELECT *, {ahead} FROM iv WINDOW w AS (PARTITION BY home ORDER BY start_time, ord)), g AS ({' UNION ALL '.join(parts)})"


_BAND = "CASE WHEN hour({t}) < 6 THEN 'Midnight' WHEN hour({t}) < 10 THEN 'Morning' WHEN hour({t}) < 18 THEN 'Daytime' ELSE 'Night' END"
_BUCKET = f"CAST(CAST(start_time AS DATE) AS VARCHAR) || '_' || {_BAND.format(t='start_time')}"


@query(f"WITH {_IV}, {_span_grams(4)}, t AS (SELECT sequence, {_SEQ} AS x, count(DISTINCT {_BUCKET}) AS support, count(*) AS cnt, quantile_cont((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 0.5) AS med, quantile_cont((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 0.9) AS p90 FROM g GROUP BY sequence HAVING count(DISTINCT {_BUCKET}) >= 2) SELECT sequence, support, cnt, round(support / (SELECT count(DISTINCT {_BUCKET}) FROM iv), 6) AS support_ratio, round(med, 3) AS median_span, round(p90, 3) AS p90_span, concat_ws(';', CASE WHEN {_SELF} THEN 'self_transition' END, CASE WHEN {_TRIP} THEN 'other_round_trip' END, CASE WHEN {_LOOP} THEN 'alternating_loop' END, CASE WHEN med > 86400 THEN 'median_duration' END, CASE WHEN p90 > 172800 THEN 'p90_duration' END) AS filter_reason FROM t")
def transaction_support(spark, sf):
    """Support of n-grams of intervals over date and band buckets, with filter reasons."""
    rows = sequences.transaction_support(sequences.intervals(log(spark, sf), ["home"]), ["home"], [OTHER], 2, most_median=86400.0, most_p90=172800.0)
    return _round(_round(rows, "support_ratio"), "median_span", "p90_span", digits=3)


def _paths_sql(revisit: bool, theta: float, most: int) -> str:
    ban = "" if revisit else " AND NOT list_contains(p.x, e.dst)"
    first = "" if revisit else " AND src <> dst"
    return f"p AS (SELECT band, [src, dst] AS x, prob AS joint, prob AS least_step FROM e WHERE prob >= {theta}{first} UNION ALL SELECT p.band, list_append(p.x, e.dst), p.joint * e.prob, least(p.least_step, e.prob) FROM p JOIN e ON p.band = e.band AND p.x[len(p.x)] = e.src WHERE len(p.x) < {most} AND e.prob >= {theta}{ban})"


@query(f"WITH RECURSIVE {_NET}, {_paths_sql(False, 0.15, 4)} SELECT band, array_to_string(x, '->') AS sequence, CAST(len(x) AS INTEGER) AS n, round(joint, 6) AS joint, round(least_step, 6) AS least_step FROM p")
def probable_paths(spark, sf):
    """Walks without returning along edges of at least 0.15."""
    e = sequences.transitions(log(spark, sf), ["home", "band"], ["band"])
    return _round(sequences.paths(e, ["band"], 2, 4, 0.15, revisit=False), "joint", "least_step")


@query(f"WITH RECURSIVE {_NET}, {_paths_sql(True, 0.0, 3)} SELECT band, array_to_string(x, '->') AS sequence, CAST(len(x) AS INTEGER) AS n, round(joint, 6) AS joint, round(least_step, 6) AS least_step FROM p")
def series_paths(spark, sf):
    """Walks that may return, of two and three states."""
    e = sequences.transitions(log(spark, sf), ["home", "band"], ["band"])
    return _round(sequences.paths(e, ["band"], 2, 3, 0.0, revisit=True), "joint", "least_step")


_WINDOWS = f"{EV}, b AS (SELECT home, min(ts) AS t0, max(ts) AS t1 FROM ev GROUP BY home), sl AS (SELECT ev.home, ev.ts, ev.ord, ev.state, (epoch_us(ts) - epoch_us(t0)) // 86400000000 AS slot FROM ev JOIN b USING (home)), tot AS (SELECT home, (epoch_us(t1) - epoch_us(t0)) // 86400000000 + 1 AS n_windows FROM b), {_grams_sql('home, slot', 1, 3, 'sl')}, ct AS (SELECT home, sequence, n, count(*) AS cnt, count(DISTINCT slot) AS windows_with FROM g GROUP BY ALL)"


@query(f"WITH {_WINDOWS} SELECT c.home, c.sequence, c.n, c.windows_with, n_windows, round(c.windows_with / n_windows, 6) AS support, round(c.cnt / p.cnt, 6) AS confidence FROM ct AS c JOIN ct AS p ON c.home = p.home AND p.n = c.n - 1 AND p.sequence = regexp_replace(c.sequence, '->[^>]*$', '') JOIN tot ON c.home = tot.home WHERE c.n >= 2")
def window_support(spark, sf):
    """Support over daily windows from a home's first event on, empty ones included, and confidence."""
    return _round(sequences.window_support(log(spark, sf), ["home"], 24), "support", "confidence")


@query(f"WITH {_WINDOWS}, m AS (SELECT c.sequence, sum(c.windows_with) / sum(n_windows) AS support, sum(c.cnt) / sum(p.cnt) AS confidence FROM ct AS c JOIN ct AS p ON c.home = p.home AND p.n = c.n - 1 AND p.sequence = regexp_replace(c.sequence, '->[^>]*$', '') JOIN tot ON c.home = tot.home WHERE c.n >= 2 GROUP BY c.sequence), f AS (SELECT sequence, count(*) AS cnt, min(n) AS n, min(ROW(ts, ord)) AS f FROM (SELECT g2.* FROM (SELECT * FROM g WHERE n >= 2) AS g2) GROUP BY sequence ORDER BY cnt DESC, sequence LIMIT 40), gr AS (SELECT s.v / 100.0 AS s, c.v / 20.0 AS c FROM range(1, 21) AS s(v), range(1, 21) AS c(v)), u AS (SELECT gr.s, gr.c, coalesce(m.support >= gr.s AND m.confidence >= gr.c, false) AS t, f.sequence IS NOT NULL AS p FROM m FULL JOIN f ON m.sequence = f.sequence, gr), k AS (SELECT s AS support_min, c AS confidence_min, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM u GROUP BY s, c) SELECT round(support_min, 6) AS support_min, round(confidence_min, 6) AS confidence_min, tp, fp, fn, tn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM k")
def threshold_grid(spark, sf):
    """F1 of the forty most frequent sequences for four hundred pairs of thresholds on pooled support and confidence."""
    e = log(spark, sf)
    w = sequences.window_support(e, ["home"], 24)
    # pooled over homes: windows with the sequence over windows, and counts over counts of prefixes
    slots = _pooled(e)
    grams = slots.filter("n >= 2").groupBy("sequence").agg(F.sum("cnt").alias("cnt"))
    top = grams.orderBy(F.desc("cnt"), "sequence").limit(40)
    total = w.groupBy("sequence").agg((F.sum("windows_with") / F.sum("n_windows")).alias("support"))
    prefix = slots.select("home", F.col("sequence").alias("_p"), F.col("cnt").alias("_c"))
    conf = slots.filter("n >= 2").withColumn("_p", F.regexp_replace("sequence", "->[^>]*$", "")).join(prefix, ["home", "_p"]).groupBy("sequence").agg((F.sum("cnt") / F.sum("_c")).alias("confidence"))
    grid = scoring.threshold_grid(total.join(conf, "sequence"), top, fn.threshold_values(0.01, 0.2, 20), fn.threshold_values(0.05, 1.0, 20))
    return _round(grid.select("support_min", "confidence_min", "tp", "fp", "fn", "tn", "f1"), "support_min", "confidence_min", "f1")


def _pooled(e: DataFrame) -> DataFrame:
    start = e.groupBy("home").agg(F.min("ts").alias("t0"))
    slotted = e.join(start, "home").withColumn("slot", F.expr("timestampdiff(MICROSECOND, t0, ts) div 86400000000"))
    return sequences.ngrams(slotted.select("home", "slot", "ts", "ord", "state"), ["home", "slot"], 1, 3).groupBy("home", "sequence", "n").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"WITH {_NET}, {_grams_sql('home, band', 2, 4)}, q AS (SELECT DISTINCT sequence FROM g), x AS (SELECT sequence, {_SEQ} AS x FROM q), pp AS (SELECT sequence, unnest(list_transform(range(1, len(x)), lambda i: {{'src': x[i], 'dst': x[i + 1]}})) AS p FROM x), ee AS (SELECT src, dst, prob FROM e WHERE band = 'Daytime') SELECT sequence, count(*) AS n_pairs, count(*) FILTER (prob IS NULL) AS missing, count(*) FILTER (prob < 0.2) AS low, count(*) FILTER (p.src = p.dst) AS self_loops, CAST(count(*) FILTER (prob IS NULL OR prob < 0.2 OR p.src = p.dst) = 0 AS INTEGER) AS grounded FROM pp LEFT JOIN ee ON pp.p.src = ee.src AND pp.p.dst = ee.dst GROUP BY sequence")
def groundedness(spark, sf):
    """Whether every step of a mined sequence is an edge of the daytime network."""
    e = log(spark, sf)
    edges = sequences.transitions(e, ["home", "band"], ["band"]).filter("band = 'Daytime'")
    return scoring.groundedness(sequences.ngram_counts(e, ["home", "band"], []).select("sequence").distinct(), edges, 0.2)


# Vectors ----------------------------------------------------------------------------------------------------------------

_LAST = ", ".join(f"coalesce(last_value(CASE WHEN sensor = '{s}' THEN bit END IGNORE NULLS) OVER w, 0) * {1 << i} AS b{i}" for i, s in enumerate(SENSORS))
_MASKS = f"{EV}, v0 AS (SELECT home, ts, ord, {_LAST} FROM ev WINDOW w AS (PARTITION BY home ORDER BY ts, ord ROWS UNBOUNDED PRECEDING)), v AS (SELECT home, ts, ord, CAST(b0 + b1 + b2 + b3 + b4 AS BIGINT) AS mask FROM v0), vc AS (SELECT home, ts, ord, mask FROM (SELECT *, lag(mask) OVER (PARTITION BY home ORDER BY ts, ord) AS p FROM v) WHERE p IS NULL OR p <> mask)"
_TOP = "st AS (SELECT CAST(row_number() OVER (ORDER BY cnt DESC, f) AS INTEGER) AS rank, mask, cnt FROM (SELECT mask, count(*) AS cnt, min(ROW(ts, ord, home)) AS f FROM vc GROUP BY mask) ORDER BY rank LIMIT 8)"


def _vectors(spark, sf):
    return vectors.event_vectors(log(spark, sf), ["home"], SENSORS)


def _states(spark, sf):
    v = vectors.compressed(_vectors(spark, sf), ["home"], ("ts", "ord"))
    return v, vectors.representative_states(v, 8, ("ts", "ord", "home"))


@query(f"WITH {_MASKS} SELECT home, ts, ord, mask FROM v")
def event_vectors(spark, sf):
    return _vectors(spark, sf)


@query(f"WITH {_MASKS} SELECT home, ts, ord, mask FROM vc")
def compressed_vectors(spark, sf):
    return vectors.compressed(_vectors(spark, sf), ["home"], ("ts", "ord"))


@query(f"WITH {_MASKS}, {_TOP} SELECT rank, 'S' || rank AS state_id, mask, cnt FROM st")
def representative_states(spark, sf):
    return _states(spark, sf)[1].select("rank", "state_id", "mask", "cnt")


def _nearest_sql(h: int) -> str:
    return f"WITH {_MASKS}, {_TOP}, m AS (SELECT mask, arg_min('S' || rank, ROW(d, rank)) AS s FROM (SELECT q.mask, st.rank, bit_count(xor(q.mask, st.mask)) AS d FROM (SELECT DISTINCT mask FROM vc) AS q, st) WHERE d <= {h} GROUP BY mask) SELECT home, ts, ord, coalesce(s, '{OTHER}') AS state FROM vc LEFT JOIN m USING (mask)"


@query(_nearest_sql(0))
def mapped_states_exact(spark, sf):
    return vectors.nearest_states(*_states(spark, sf), 0).select("home", "ts", "ord", "state")


@query(_nearest_sql(1))
def mapped_states_near(spark, sf):
    return vectors.nearest_states(*_states(spark, sf), 1).select("home", "ts", "ord", "state")


_GRID = f"{EV}, sl AS (SELECT home, sensor, bit, ts, ord, greatest(0, CAST(ceil((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0) AS BIGINT)) AS slot FROM ev), la AS (SELECT home, slot, sensor, arg_max(bit, ROW(ts, ord)) AS bit FROM sl WHERE slot < 720 GROUP BY ALL), gd AS (SELECT home, g.slot FROM (SELECT DISTINCT home FROM ev) AS h, range(0, 720) AS g(slot)), pv AS (SELECT home, slot, {', '.join(f'max(CASE WHEN sensor = {chr(39)}{s}{chr(39)} THEN bit END) AS x{i}' for i, s in enumerate(SENSORS))} FROM la GROUP BY home, slot), sh AS (SELECT gd.home, TIMESTAMP '2024-01-01' + to_hours(CAST(gd.slot AS INTEGER)) AS ts, CAST({' + '.join(f'coalesce(last_value(x{i} IGNORE NULLS) OVER w, 0) * {1 << i}' for i in range(5))} AS BIGINT) AS mask FROM gd LEFT JOIN pv USING (home, slot) WINDOW w AS (PARTITION BY gd.home ORDER BY gd.slot ROWS UNBOUNDED PRECEDING))"


def _grid(spark, sf):
    return vectors.sample_and_hold(log(spark, sf), ["home"], SENSORS, "2024-01-01 00:00:00", 3600, 720)


@query(f"WITH {_GRID} SELECT home, ts, mask FROM sh")
def sample_and_hold(spark, sf):
    return _grid(spark, sf)


@query(f"WITH {_GRID}, do1 AS (SELECT home, ts, bit_or(mask) OVER (PARTITION BY home ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mask FROM sh), c AS (SELECT *, lag(mask) OVER (PARTITION BY home ORDER BY ts) AS p FROM do1) SELECT home, ts, mask FROM c WHERE p IS NULL OR p <> mask")
def delayed_off(spark, sf):
    """Hourly vectors, off delayed by five rows, compressed."""
    return vectors.compressed(vectors.delayed_off(_grid(spark, sf), ["home"], 5), ["home"])


_NETIV = f"""{EV}, f AS (SELECT home, epoch_us(min(date_trunc('day', ts))) AS t0 FROM ev GROUP BY home),
l AS (SELECT ev.home, t0, t0 + 2592000000000 AS t1, sensor, CAST(ceil(epoch_us(ts) / 1000000.0) AS BIGINT) * 1000000 AS us, arg_max(bit, ROW(ts, ord)) AS bit FROM ev JOIN f USING (home) WHERE epoch_us(ts) < t0 + 2592000000000 GROUP BY ALL),
ch AS (SELECT * FROM (SELECT *, lag(bit) OVER (PARTITION BY home, sensor ORDER BY us) AS p FROM l) WHERE bit <> p OR (p IS NULL AND bit = 1)),
o AS (SELECT home, t0, t1, sensor, bit, us, least(coalesce(lead(us) OVER (PARTITION BY home, sensor ORDER BY us) + 3599000000, t1), t1) AS e FROM ch),
o1 AS (SELECT * FROM o WHERE bit = 1 AND e > us),
oi AS (SELECT *, max(e) OVER (PARTITION BY home, sensor ORDER BY us, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o1),
oj AS (SELECT *, sum(CASE WHEN reach IS NULL OR us > reach THEN 1 ELSE 0 END) OVER (PARTITION BY home, sensor ORDER BY us, e ROWS UNBOUNDED PRECEDING) AS isl FROM oi),
om AS (SELECT home, t1, sensor, isl, min(us) AS a, max(e) AS b FROM oj GROUP BY ALL),
wt AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {1 << i})" for i, s in enumerate(SENSORS))}) AS t(sensor, w)),
dl AS (SELECT home, t1, us, sum(d) AS d FROM (SELECT home, t1, a AS us, w AS d FROM om JOIN wt USING (sensor) UNION ALL SELECT home, t1, b, -w FROM om JOIN wt USING (sensor) UNION ALL SELECT home, t0 + 2592000000000, t0, 0 FROM f) GROUP BY ALL),
mk AS (SELECT * FROM (SELECT home, t1, us, CAST(sum(d) OVER (PARTITION BY home ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS mask FROM dl) WHERE us < t1),
kp AS (SELECT * FROM (SELECT *, lag(mask) OVER (PARTITION BY home ORDER BY us) AS p FROM mk) WHERE p IS NULL OR p <> mask)"""


@query(f"WITH {_NETIV} SELECT home, make_timestamp(us) AS start_time, make_timestamp(coalesce(lead(us) OVER (PARTITION BY home ORDER BY us), t1)) AS end_time, mask FROM kp")
def network_intervals(spark, sf):
    """Grid-free states over thirty days, off delayed by an hour less a second."""
    return vectors.network_intervals(log(spark, sf), ["home"], SENSORS, 30, 3600)


# Intervals --------------------------------------------------------------------------------------------------------------


@query(f"WITH {EV}, s AS (SELECT home, k % 10 AS kk, ts, row_number() OVER (PARTITION BY home, k % 10 ORDER BY ts, ord) AS nth FROM ev WHERE sensor = 'signup'), e AS (SELECT home, k % 10 AS kk, ts, row_number() OVER (PARTITION BY home, k % 10 ORDER BY ts, ord) AS nth FROM ev WHERE sensor = 'purchase') SELECT s.home, s.kk, CAST(s.nth AS INTEGER) AS nth, s.ts AS start_time, e.ts AS end_time FROM s JOIN e USING (home, kk, nth)")
def paired_in_order(spark, sf):
    """The nth start with the nth end of each home and label."""
    e = log(spark, sf).withColumn("kk", F.col("k") % 10)
    return intervals.pair_in_order(e.filter("sensor = 'signup'"), e.filter("sensor = 'purchase'"), ["home", "kk"]).select("home", "kk", "nth", "start_time", "end_time")


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT home, k % 10 AS kk, ts, sensor = 'signup' AS opens, row_number() OVER (PARTITION BY home, k % 10 ORDER BY ts, ord) AS n FROM ev WHERE sensor IN ('signup', 'purchase')),
m AS (SELECT DISTINCT home, kk, 0 AS n, [] :: TIMESTAMP[] AS held, NULL :: TIMESTAMP AS a, NULL :: TIMESTAMP AS b FROM r UNION ALL
  SELECT r.home, r.kk, r.n, CASE WHEN opens THEN list_append(held, ts) ELSE held[1:len(held) - 1] END, CASE WHEN NOT opens AND len(held) > 0 THEN held[len(held)] END, ts FROM m JOIN r ON r.home = m.home AND r.kk = m.kk AND r.n = m.n + 1)
SELECT home, kk, a AS start_time, b AS end_time FROM m WHERE a < b""")
def paired_annotations(spark, sf):
    """Nested begin and end marks of each home and label; ends without a begin are left out."""
    e = log(spark, sf).withColumn("kk", F.col("k") % 10)
    marks = e.filter(F.col("sensor").isin("signup", "purchase")).withColumn("kind", F.when(F.col("sensor") == "signup", F.lit("begin")).otherwise(F.lit("end")))
    return intervals.pair_annotations(marks, ["home", "kk"])


_OV = "(epoch_us(least(a.end_time, b.end_time)) - epoch_us(greatest(a.start_time, b.start_time))) / 1e6"


@query(f"WITH {INTERVAL_TABLES} SELECT a.home, a.category, b.category AS b_category, a.start_time, b.start_time AS b_start_time, round({_OV}, 3) AS overlap FROM pr AS a JOIN tr AS b ON a.home = b.home AND a.start_time < b.end_time AND b.start_time < a.end_time")
def overlap_join(spark, sf):
    e = log(spark, sf)
    j = intervals.overlap_join(predictions(e).drop("ord"), truths(e).drop("ord"), ["home"])
    return _round(j.select("home", "category", "b_category", "start_time", "b_start_time", "overlap"), "overlap", digits=3)


_UNION = "{o} AS (SELECT home, min(start_time) AS start_time, max(end_time) AS end_time FROM (SELECT *, sum(CASE WHEN r IS NULL OR start_time > r THEN 1 ELSE 0 END) OVER (PARTITION BY home ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, max(end_time) OVER (PARTITION BY home ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {i})) GROUP BY home, isl)"


@query(f"WITH {INTERVAL_TABLES}, {_UNION.format(o='ut', i='tr')} SELECT home, start_time, end_time FROM ut")
def united_spans(spark, sf):
    return intervals.union_spans(truths(log(spark, sf)), ["home"])


@query(f"WITH {INTERVAL_TABLES}, {_UNION.format(o='ut', i='tr')}, {_UNION.format(o='up', i='pr')} SELECT a.home, greatest(a.start_time, b.start_time) AS start_time, least(a.end_time, b.end_time) AS end_time FROM up AS a JOIN ut AS b ON a.home = b.home AND a.start_time < b.end_time AND b.start_time < a.end_time")
def shared_spans(spark, sf):
    """What the unions of predictions and truths have in common."""
    e = log(spark, sf)
    return intervals.intersections(predictions(e), truths(e), ["home"])


_IOU = "(epoch_us(least(a.end_time, b.end_time)) - epoch_us(greatest(a.start_time, b.start_time))) / (epoch_us(greatest(a.end_time, b.end_time)) - epoch_us(least(a.start_time, b.start_time)))"


@query(f"WITH {INTERVAL_TABLES} SELECT a.home, a.category, a.start_time, b.start_time AS b_start_time, round({_IOU}, 6) AS iou FROM pr AS a JOIN tr AS b ON a.home = b.home AND a.start_time < b.end_time AND b.start_time < a.end_time WHERE {_IOU} >= 0.05")
def iou_pairs(spark, sf):
    """Pairs in one home with IoU of at least 0.05, of any categories."""
    e = log(spark, sf)
    t = truths(e).drop("ord", "category")
    return _round(intervals.iou_pairs(predictions(e).drop("ord"), t, ["home"], 0.05).select("home", "category", "start_time", "b_start_time", "iou"), "iou")


@query(f"WITH {INTERVAL_TABLES} SELECT a.home, a.start_time, a.end_time, a.ord, CASE WHEN a.category <> 'Sleeping' AND (SELECT max(b.end_time) FROM tr AS b WHERE b.home = a.home AND b.category = 'Sleeping' AND b.end_time <= a.start_time) >= a.start_time - INTERVAL 2 DAY THEN 'Wake_Up' ELSE a.category END AS category FROM tr AS a")
def wake_up_rule(spark, sf):
    """Intervals that start within two days after a sleep ended become wake-ups."""
    return intervals.relabel_after(truths(log(spark, sf)), ["home"], F.col("category") == "Sleeping", "Wake_Up", 172_800.0)


@query(f"WITH {INTERVAL_TABLES} SELECT a.home, a.start_time, a.end_time, EXISTS (SELECT 1 FROM tr AS b WHERE b.home = a.home AND b.start_time <= a.start_time AND b.end_time >= a.end_time) AS inside FROM pr AS a")
def containment(spark, sf):
    e = log(spark, sf)
    return intervals.contained(predictions(e), truths(e), ["home"])


@query(f"WITH {INTERVAL_TABLES}, m AS (SELECT *, sum(CASE WHEN r IS NULL OR epoch_us(start_time) - epoch_us(r) > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY home ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, max(end_time) OVER (PARTITION BY home ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM pr)) SELECT home, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS n FROM m GROUP BY home, isl")
def merged_gaps(spark, sf):
    """Predictions of a home that lie a day apart at most, as one."""
    return intervals.merge_gaps(predictions(log(spark, sf)), ["home"], 86_400.0)


@query(f"WITH {INTERVAL_TABLES}, h AS (SELECT b.home, b.category, b.ord, max(CAST(a.start_time < b.end_time AND b.start_time < a.end_time AS INTEGER)) AS o FROM tr AS b JOIN pr AS a ON a.home = b.home AND a.category = b.category AND a.start_time <= b.end_time + INTERVAL 7200 SECOND AND b.start_time <= a.end_time + INTERVAL 7200 SECOND GROUP BY ALL) SELECT category, count(*) AS n_truth, CAST(sum(coalesce(o, 0)) AS BIGINT) AS hit_overlap, count(o) AS hit_tolerance FROM tr LEFT JOIN h USING (home, category, ord) GROUP BY category")
def hit_rates(spark, sf):
    e = log(spark, sf)
    return intervals.hit_rates(predictions(e), truths(e).drop("ord"), ["home"], "category", 7200.0)


@query(f"""WITH RECURSIVE {INTERVAL_TABLES}, o AS (SELECT a.home, a.ord AS prediction, b.ord AS truth, {_IOU} AS iou FROM pr AS a JOIN tr AS b ON a.home = b.home AND a.start_time < b.end_time AND b.start_time < a.end_time),
r AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY iou DESC, prediction DESC, truth DESC) AS nth FROM o WHERE iou >= 0.01),
m AS (SELECT DISTINCT home, 0 AS nth, [] :: BIGINT[] AS ps, [] :: BIGINT[] AS ts, false AS hit FROM r UNION ALL SELECT r.home, r.nth, CASE WHEN f THEN list_append(ps, prediction) ELSE ps END, CASE WHEN f THEN list_append(ts, truth) ELSE ts END, f FROM m JOIN r ON r.home = m.home AND r.nth = m.nth + 1, LATERAL (SELECT NOT list_contains(ps, prediction) AND NOT list_contains(ts, truth) AS f) AS l)
SELECT home, prediction, truth, round(iou, 6) AS iou FROM m JOIN r USING (home, nth) WHERE hit""")
def greedy_matches(spark, sf):
    """One-to-one matches of a home's predictions and truths, best IoU first."""
    e = log(spark, sf)
    pairs = intervals.iou_pairs(predictions(e).withColumnRenamed("ord", "prediction").drop("category"), truths(e).withColumnRenamed("ord", "truth").drop("category"), ["home"], 0.01)
    return _round(intervals.greedy_match(pairs.withColumnRenamed("b_truth", "truth"), ["home"], "prediction", "truth", "iou"), "iou")


_TOP10 = f"tp AS (SELECT sequence FROM (SELECT sequence, count(*) AS c FROM g GROUP BY sequence) ORDER BY c DESC, sequence LIMIT 30)"


@query(f"WITH {_IV}, {_span_grams(4)}, {_TOP10} SELECT home, sequence, start_time, end_time FROM g WHERE sequence IN (SELECT sequence FROM tp)")
def exact_occurrences(spark, sf):
    """Where the thirty most frequent sequences of intervals stand."""
    held = sequences.intervals(log(spark, sf), ["home"])
    return sequences.occurrences(held, ["home"], _top_spans(held))


def _top_spans(held: DataFrame) -> DataFrame:
    w = Window.partitionBy("home").orderBy("start_time", "ord")
    rows = held
    for i in range(1, 4):
        rows = rows.withColumn(f"s{i}", F.lead("state", i).over(w))
    made = [F.when(F.col(f"s{n - 1}").isNotNull(), F.concat_ws(fn.ARROW, "state", *(f"s{i}" for i in range(1, n)))) for n in range(2, 5)]
    grams = rows.select(F.explode(F.array_compact(F.array(*made))).alias("sequence"))
    return grams.groupBy("sequence").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "sequence").limit(30).select("sequence")


def _skip_sql() -> str:
    names = ["state", "s1", "s2", "s3", "s4"]
    parts = [f"SELECT home, start_time, {' || chr(45) || chr(62) || '.join(names[:n])} AS sequence, e{n - 1} AS end_time FROM a5 WHERE s{n - 1} IS NOT NULL" for n in range(2, 5)]
    for n in range(3, 6):
        for k in range(1, n - 1):
            kept = " || chr(45) || chr(62) || ".join(names[i] for i in range(n) if i != k)
            parts.append(f"SELECT home, start_time, {kept}, e{n - 1} FROM a5 WHERE s{n - 1} IS NOT NULL AND s{k} = '{OTHER}' AND d{k} <= 43200 AND {names[k + 1]} <> '{OTHER}'")
    ahead = ", ".join(f"lead(state, {i}) OVER w AS s{i}, lead(end_time, {i}) OVER w AS e{i}, lead((epoch_us(end_time) - epoch_us(start_time)) / 1e6, {i}) OVER w AS d{i}" for i in range(1, 5))
    return f"a5 AS (SELECT *, {ahead} FROM iv WINDOW w AS (PARTITION BY home ORDER BY start_time, ord)), gs AS ({' UNION ALL '.join(parts)})"


@query(f"WITH {_IV}, {_span_grams(4)}, {_TOP10}, {_skip_sql()} SELECT home, sequence, start_time, min(end_time) AS end_time FROM gs WHERE sequence IN (SELECT sequence FROM tp) GROUP BY ALL")
def skipping_occurrences(spark, sf):
    """The same, where one unmapped interval of twelve hours at most may be passed over."""
    held = sequences.intervals(log(spark, sf), ["home"])
    return sequences.occurrences(held, ["home"], _top_spans(held), OTHER, 43_200.0)


# Scores -----------------------------------------------------------------------------------------------------------------

_OVERLAPS = f"{INTERVAL_TABLES}, ov AS (SELECT a.home, b.category, {_OV} AS overlap FROM pr AS a JOIN tr AS b ON a.home = b.home AND a.start_time < b.end_time AND b.start_time < a.end_time), du AS (SELECT home, sum((epoch_us(end_time) - epoch_us(start_time)) / 1e6) AS duration FROM pr GROUP BY home)"


def _overlaps(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = log(spark, sf)
    p = predictions(e).select("home", "start_time", "end_time")
    o = intervals.overlap_join(p, truths(e).select("home", "category", "start_time", "end_time"), ["home"])
    total = p.groupBy("home").agg(F.sum(fn.seconds_between("start_time", "end_time")).alias("duration"))
    return o.select("home", F.col("b_category").alias("category"), "overlap"), total


@query(f"WITH {_OVERLAPS}, s AS (SELECT home, category, sum(overlap) AS overlap, count(*) AS support FROM ov GROUP BY ALL) SELECT home, category, round(overlap, 3) AS overlap, round(overlap / duration, 6) AS confidence, support FROM s JOIN du USING (home) QUALIFY row_number() OVER (PARTITION BY home ORDER BY overlap DESC, category DESC) = 1")
def best_category(spark, sf):
    o, total = _overlaps(spark, sf)
    return _round(_round(scoring.assign_best(o, ["home"], total), "overlap", digits=3), "confidence")


@query(f"WITH {_OVERLAPS}, s AS (SELECT home, category, sum(overlap) AS overlap FROM ov GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY overlap DESC, category) AS r FROM s JOIN du USING (home)), k AS (SELECT home, string_agg(category, '|' ORDER BY r) AS categories FROM r WHERE (r = 1 OR overlap >= 0.1 * duration) AND r <= 3 GROUP BY home) SELECT du.home, coalesce(categories, 'Other_ADL') AS categories FROM du LEFT JOIN k USING (home)")
def category_sets(spark, sf):
    o, total = _overlaps(spark, sf)
    return scoring.assign_set(o, ["home"], total).select("home", F.array_join("categories", "|").alias("categories"))


_SETS = f"{_OVERLAPS}, s AS (SELECT home, category, sum(overlap) AS overlap FROM ov GROUP BY ALL), tl AS (SELECT home, list(category ORDER BY category) AS t FROM (SELECT *, sum(overlap) OVER (PARTITION BY home) AS total FROM s) WHERE overlap >= 0.2 * total GROUP BY home), pl AS (SELECT home, list(DISTINCT category) AS p FROM pr GROUP BY home), sm AS (SELECT home, len(list_intersect(p, t)) AS b, len(p) AS np, len(t) AS nt FROM pl JOIN tl USING (home))"


@query(f"WITH {_SETS} SELECT home, CAST(b = np AND b = nt AS INTEGER) AS exact_set_match, round(b / (np + nt - b), 6) AS jaccard, round(b / np, 6) AS precision, round(b / nt, 6) AS recall, round(2.0 * b / (np + nt), 6) AS f1 FROM sm")
def set_scores(spark, sf):
    """Predicted label sets of homes against those that hold a fifth of the overlap."""
    rows = _set_rows(spark, sf)
    return _round(rows, "jaccard", "precision", "recall", "f1")


def _set_rows(spark, sf) -> DataFrame:
    o, _ = _overlaps(spark, sf)
    t = scoring.true_sets(o, ["home"], 0.2)
    p = predictions(log(spark, sf)).groupBy("home").agg(F.collect_set("category").alias("p"))
    both = p.join(t, "home")
    return both.select("home", *(c.alias(n) for n, c in fn.set_scores(F.col("p"), F.col("labels")).items()))


_CAT = f"{INTERVAL_TABLES}, hp AS (SELECT DISTINCT a.home, a.ord FROM pr AS a JOIN tr AS b ON a.home = b.home AND a.category = b.category AND a.start_time < b.end_time + INTERVAL 1 DAY AND b.start_time < a.end_time + INTERVAL 1 DAY), ht AS (SELECT DISTINCT b.home, b.ord FROM pr AS a JOIN tr AS b ON a.home = b.home AND a.category = b.category AND a.start_time < b.end_time + INTERVAL 1 DAY AND b.start_time < a.end_time + INTERVAL 1 DAY), cp AS (SELECT category, count(hp.ord) AS tp, count(*) - count(hp.ord) AS fp FROM pr LEFT JOIN hp USING (home, ord) GROUP BY category), ct AS (SELECT category, count(*) - count(ht.ord) AS fn FROM tr LEFT JOIN ht USING (home, ord) GROUP BY category), k AS (SELECT category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM cp FULL JOIN ct USING (category)), m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM k), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM m)"


def _categories(spark, sf) -> DataFrame:
    e = log(spark, sf)
    p, t = predictions(e).withColumnRenamed("ord", "pid"), truths(e).withColumnRenamed("ord", "tid")
    near = intervals.overlap_join(p, t, ["home", "category"], tolerance=86_399.999999)
    hp, ht = near.select("home", "pid").distinct().withColumn("_h", F.lit(1)), near.select("home", F.col("b_tid").alias("tid")).distinct().withColumn("_h", F.lit(1))
    cp = p.join(hp, ["home", "pid"], "left").groupBy("category").agg(F.count("_h").alias("tp"), F.count_if(F.col("_h").isNull()).alias("fp"))
    ct = t.join(ht, ["home", "tid"], "left").groupBy("category").agg(F.count_if(F.col("_h").isNull()).alias("fn"))
    return scoring.by_category(cp.join(ct, "category", "full").fillna(0, ["tp", "fp", "fn"]).withColumn("part", F.lit("all")), ["part"])


@query(f"WITH {_CAT} SELECT 'all' AS part, category, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f")
def category_scores(spark, sf):
    """Predictions with a truth of their category within a day, and truths without one."""
    return _round(_categories(spark, sf), "precision", "recall", "f1")


@query(f"WITH {_CAT}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(p) AS mp, avg(r) AS mr, avg(f1) AS mf, sum(f1 * (tp + fn)) AS wf FROM f) SELECT 'all' AS part, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(tp / (tp + fp), 6) AS micro_precision, round(tp / (tp + fn), 6) AS micro_recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS micro_f1, round(wf / (tp + fn), 6) AS weighted_f1 FROM s")
def averaged_scores(spark, sf):
    a = scoring.averages(_categories(spark, sf), ["part"])
    return _round(a, *a.columns[1:])


@query(f"WITH {_SETS}, x AS (SELECT home % 2 AS method, home % 5 + 1 AS run, b / (np + nt - b) AS jaccard, 2.0 * b / (np + nt) AS f1 FROM sm), r AS (SELECT method, run, avg(jaccard) AS jaccard, avg(f1) AS f1 FROM x GROUP BY ALL) SELECT method, count(*) AS n_runs, round(avg(jaccard), 6) AS jaccard_mean, round(coalesce(stddev_samp(jaccard), 0.0), 6) AS jaccard_sd, round(avg(f1), 6) AS f1_mean, round(coalesce(stddev_samp(f1), 0.0), 6) AS f1_sd FROM r GROUP BY method")
def run_means(spark, sf):
    out = scoring.over_runs(_runs(spark, sf), ["method"], ["jaccard", "f1"])
    return _round(out, "jaccard_mean", "jaccard_sd", "f1_mean", "f1_sd")


def _runs(spark, sf) -> DataFrame:
    rows = _set_rows(spark, sf).select((F.col("home") % 2).alias("method"), (F.col("home") % 5 + 1).alias("run"), "jaccard", "f1")
    return rows.groupBy("method", "run").agg(F.avg("jaccard").alias("jaccard"), F.avg("f1").alias("f1"))


@query(f"WITH {_SETS}, r AS (SELECT home % 2 AS method, home % 5 + 1 AS run, avg(2.0 * b / (np + nt)) AS f1 FROM sm GROUP BY ALL) SELECT a.run, round(a.f1, 6) AS value_a, round(b.f1, 6) AS value_b, round(b.f1 - a.f1, 6) AS delta FROM r AS a JOIN r AS b ON a.run = b.run AND a.method = 0 AND b.method = 1")
def paired_runs(spark, sf):
    return _round(scoring.common_runs(_runs(spark, sf), "method", "run", "f1", 0, 1), "value_a", "value_b", "delta")


_FREQ = f"{EV}, {runs_sql('home')}, {_grams_sql('home', 2, 3)}, fq AS (SELECT sequence, count(*) AS cnt FROM g GROUP BY sequence)"


@query(f"WITH {_FREQ} SELECT sequence, cnt, ([CAST('Low' AS VARCHAR), 'Middle', 'High'])[ntile(3) OVER (ORDER BY cnt, sequence)] AS frequency_band, CASE WHEN cnt < 1 THEN '0' WHEN cnt < 10 THEN '1-9' WHEN cnt < 100 THEN '10-99' WHEN cnt < 1000 THEN '100-999' WHEN cnt < 10000 THEN '1000-9999' ELSE '10000+' END AS bin FROM fq")
def frequency_bands(spark, sf):
    c = sequences.ngram_counts(log(spark, sf), ["home"], [], 2, 3).select("sequence", "cnt", F.lit("all").alias("part"))
    return scoring.tertiles(c, ["part"], ["cnt", "sequence"]).withColumn("bin", scoring.fixed_bins("cnt")).drop("part")


@query(f"WITH {_FREQ}, b AS (SELECT *, ([CAST('Low' AS VARCHAR), 'Middle', 'High'])[ntile(3) OVER (ORDER BY cnt, sequence)] AS frequency_band, CASE WHEN contains(sequence, '{OTHER}') THEN NULL ELSE len(sequence) / 100.0 END AS m FROM fq) SELECT frequency_band, count(*) AS n, count(m) AS n_evaluable, round(avg(m), 6) AS mean, round(sum(m * cnt) / sum(CASE WHEN m IS NOT NULL THEN cnt END), 6) AS weighted_mean, CAST(sum(cnt) AS BIGINT) AS weight FROM b GROUP BY frequency_band")
def stratified_means(spark, sf):
    c = sequences.ngram_counts(log(spark, sf), ["home"], [], 2, 3).select("sequence", "cnt", F.lit("all").alias("part"))
    rows = scoring.tertiles(c, ["part"], ["cnt", "sequence"]).withColumn("m", F.when(F.contains("sequence", F.lit(OTHER)), None).otherwise(F.length("sequence") / F.lit(100.0)))
    return _round(scoring.weighted_summary(rows, ["frequency_band"], "m", "cnt"), "mean", "weighted_mean")


_DAYS = f"{EV}, {runs_sql('home, date, band')}, {_grams_sql('home, date, band', 2, 3)}, tn AS (SELECT * FROM g WHERE ts < TIMESTAMP '{SPLIT}'), te AS (SELECT * FROM g WHERE ts >= TIMESTAMP '{SPLIT}'), pt AS (SELECT band, sequence FROM (SELECT band, sequence, row_number() OVER (PARTITION BY band ORDER BY count(*) DESC, sequence) AS r FROM tn GROUP BY band, sequence) WHERE r <= 10)"


@query(f"WITH {_DAYS}, x AS (SELECT band, sequence, count(*) AS o, count(DISTINCT date) AS d FROM tn GROUP BY ALL), y AS (SELECT band, sequence, count(*) AS o, count(DISTINCT date) AS d FROM te GROUP BY ALL), xd AS (SELECT band, count(DISTINCT date) AS n FROM tn GROUP BY band), yd AS (SELECT band, count(DISTINCT date) AS n FROM te GROUP BY band) SELECT band, sequence, coalesce(x.o, 0) AS train_occurrences, coalesce(x.d, 0) AS train_days, coalesce(xd.n, 0) AS train_eligible, coalesce(y.o, 0) AS test_occurrences, coalesce(y.d, 0) AS test_days, coalesce(yd.n, 0) AS test_eligible, round(CASE WHEN coalesce(yd.n, 0) > 0 THEN coalesce(y.d, 0) / yd.n ELSE 0.0 END, 6) AS day_recurrence, round(CASE WHEN coalesce(x.o, 0) > 0 AND xd.n > 0 THEN (CASE WHEN coalesce(yd.n, 0) > 0 THEN coalesce(y.o, 0) / yd.n ELSE 0.0 END) / (x.o / xd.n) END, 6) AS rate_ratio, CAST(coalesce(y.o, 0) > 0 AS INTEGER) AS supported FROM pt LEFT JOIN x USING (band, sequence) LEFT JOIN y USING (band, sequence) LEFT JOIN xd USING (band) LEFT JOIN yd USING (band)")
def holdout_recurrence(spark, sf):
    """The ten most frequent sequences of each band before the split, and how they recur after it."""
    pats, train, test = _holdout(spark, sf)
    return _round(scoring.holdout_recurrence(pats, train, test), "day_recurrence", "rate_ratio")


def _holdout(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    keys = ["home", "date", "band"]
    grams = sequences.ngrams(sequences.runs(log(spark, sf), keys), keys, 2, 3)
    split = F.lit(SPLIT).cast("timestamp_ntz")
    train, test = grams.filter(F.col("ts") < split), grams.filter(F.col("ts") >= split)
    top = train.groupBy("band", "sequence").agg(F.count(F.lit(1)).alias("c"))
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("c"), "sequence"))).filter("r <= 10")
    return top.select("band", "sequence"), train, test


@query(f"WITH {_DAYS}, rp AS (SELECT *, row_number() OVER (PARTITION BY home, date, band ORDER BY ts, ord) AS pos FROM r), l AS (SELECT *, lead(state) OVER w AS s1, lead(state, 2) OVER w AS s2 FROM rp WINDOW w AS (PARTITION BY home, date, band ORDER BY pos)), cv AS (SELECT DISTINCT home, date, band, pos FROM (SELECT l.home, l.date, l.band, l.pos FROM l JOIN pt ON l.band = pt.band AND l.state || '->' || l.s1 = pt.sequence UNION ALL SELECT l.home, l.date, l.band, unnest([l.pos, l.pos + 1]) FROM l JOIN pt ON l.band = pt.band AND l.state || '->' || l.s1 || '->' || l.s2 = pt.sequence)), tt AS (SELECT band, count(*) AS n_transitions FROM l WHERE s1 IS NOT NULL GROUP BY band) SELECT band, n_transitions, coalesce(c, 0) AS covered, round(coalesce(c, 0) / n_transitions, 6) AS coverage FROM tt LEFT JOIN (SELECT band, count(*) AS c FROM cv GROUP BY band) USING (band)")
def transition_coverage(spark, sf):
    keys = ["home", "date", "band"]
    pats, _, _ = _holdout(spark, sf)
    r = sequences.runs(log(spark, sf), keys)
    r = r.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "ord")))
    return _round(scoring.transition_coverage(r.select(*keys, "pos", "state"), keys, pats, ["band"]), "coverage")


# Statistics -------------------------------------------------------------------------------------------------------------


@query(f"WITH {EV}, d AS (SELECT home, date, count(*) AS n FROM ev GROUP BY ALL) SELECT home, count(*) AS n_days, CAST(sum(n) AS BIGINT) AS n_events, round(avg(n), 6) AS mean_per_day, round(stddev_pop(n) / avg(n), 6) AS daily_cv FROM d GROUP BY home")
def daily_variation(spark, sf):
    return _round(stats.daily_variation(log(spark, sf), ["home"]), "mean_per_day", "daily_cv")


@query(f"WITH {EV}, h AS (SELECT sensor, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY ALL) SELECT sensor, hour, n, round(n / sum(n) OVER (PARTITION BY sensor), 6) AS share FROM h")
def hour_histogram(spark, sf):
    return _round(stats.hour_histogram(log(spark, sf), ["sensor"]), "share")


@query(f"WITH {EV}, g AS (SELECT sensor, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY home, sensor ORDER BY ts, ord))) / 1e6 AS gap FROM ev) SELECT sensor, count(gap) AS n_gaps, round(avg(gap), 3) AS mean_gap, round(quantile_cont(gap, 0.5), 3) AS median_gap, round(quantile_cont(gap, 0.9), 3) AS p90_gap FROM g GROUP BY sensor")
def event_gaps(spark, sf):
    return _round(stats.gaps(log(spark, sf), ["home", "sensor"], ["sensor"]), "mean_gap", "median_gap", "p90_gap", digits=3)


@query(f"WITH {EV}, c AS (SELECT * FROM (SELECT *, lag(bit) OVER (PARTITION BY home, sensor ORDER BY ts, ord) AS p FROM ev) WHERE (p IS NULL AND bit = 1) OR p <> bit), s AS (SELECT sensor, bit, (epoch_us(lead(ts) OVER (PARTITION BY home, sensor ORDER BY ts, ord)) - epoch_us(ts)) / 1e6 AS s FROM c) SELECT sensor, count(s) FILTER (bit = 1) AS n_on, round(avg(s) FILTER (bit = 1), 3) AS mean_on, round(quantile_cont(s, 0.5) FILTER (bit = 1), 3) AS median_on, count(s) FILTER (bit = 0) AS n_off, round(quantile_cont(s, 0.5) FILTER (bit = 0), 3) AS median_off FROM s WHERE s IS NOT NULL GROUP BY sensor")
def activations(spark, sf):
    return _round(stats.activations(log(spark, sf), ["home", "sensor"], ["sensor"]), "mean_on", "median_on", "median_off", digits=3)


@query(f"WITH {EV}, a AS (SELECT hour(ts) AS h, count(*) AS n FROM ev WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY h), b AS (SELECT hour(ts) AS h, count(*) AS n FROM ev WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY h), j AS (SELECT h, coalesce(a.n, 0) / (SELECT sum(n) FROM a) AS p, coalesce(b.n, 0) / (SELECT sum(n) FROM b) AS q FROM a FULL JOIN b USING (h)), m AS (SELECT *, (p + q) / 2 AS m, abs(sum(p) OVER (ORDER BY h) - sum(q) OVER (ORDER BY h)) AS d FROM j) SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0.0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0.0 END) / 2, 6) AS js, round(sum(d), 6) AS cdf_distance, count(*) AS n_keys FROM m")
def hour_divergence(spark, sf):
    """How the hours of events differ before and after the split."""
    e, split = log(spark, sf).withColumn("h", F.hour("ts")), F.lit(SPLIT).cast("timestamp_ntz")
    a, b = (x.groupBy("h").agg(F.count(F.lit(1)).alias("n")) for x in (e.filter(F.col("ts") < split), e.filter(F.col("ts") >= split)))
    return _round(stats.divergence(a, b, "h"), "js", "cdf_distance")


@query(f"WITH {EV}, t AS (SELECT (i + 0.5) / 256 AS p FROM range(0, 256) AS r(i)), l AS (SELECT list((i + 0.5) / 256 ORDER BY i) AS ps FROM range(0, 256) AS r(i)), q AS (SELECT (SELECT quantile_cont(value, [{', '.join(str((i + 0.5) / 256) for i in range(256))}]) FROM ev WHERE sensor = 'view') AS a, (SELECT quantile_cont(value, [{', '.join(str((i + 0.5) / 256) for i in range(256))}]) FROM ev WHERE sensor = 'click') AS b) SELECT round(avg(abs(x.u - x.v)), 6) AS distance FROM (SELECT unnest(list_transform(range(1, 257), lambda i: {{'u': a[i], 'v': b[i]}})) AS x FROM q)")
def quantile_distance(spark, sf):
    e = log(spark, sf)
    return _round(stats.quantile_distance(e.filter("sensor = 'view'"), e.filter("sensor = 'click'"), "value"), "distance")


@query(f"WITH {EV}, n AS (SELECT home, state, CASE WHEN row_number() OVER w = 1 OR state <> lag(state) OVER w THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY home ORDER BY ts, ord)) SELECT home, count(*) AS n_rows, count(DISTINCT state) AS n_values, CAST(sum(new) AS BIGINT) AS n_runs FROM n GROUP BY home")
def profile(spark, sf):
    return stats.profile(log(spark, sf), ["home"], ["ts", "ord"], "state")


@query("WITH c AS (SELECT conv_id % 7 AS model, conv_id, CAST(greatest(1, CAST(ceil(strlen(text) * 11 / 10) AS BIGINT) + 32) AS BIGINT) AS tokens FROM conversations), t AS (SELECT model, count(*) AS n_calls, CAST(sum(tokens) AS BIGINT) AS input_tokens FROM c GROUP BY model) SELECT model, n_calls, input_tokens, CAST(round(CAST(input_tokens AS DECIMAL(20,0)) * CAST(1.25 AS DECIMAL(12,6)) / 1000000, 8) AS DOUBLE) AS cost_usd FROM t")
def token_costs(spark, sf):
    """Estimated input tokens of conversation turns and their cost at 1.25 dollars a million."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").filter(F.col("text").isNotNull() | F.lit(True))
    t = c.select((F.col("conv_id") % 7).alias("model"), fn.approximate_tokens("text").alias("tokens")).groupBy("model").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("tokens").alias("input_tokens"))
    return t.withColumn("cost_usd", F.round(fn.token_cost(F.col("input_tokens"), F.lit("1.25")), 8).cast("double"))


@query("WITH w AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT p AS src, role AS dst, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (PARTITION BY p), 6) AS prob FROM w WHERE p IS NOT NULL AND p <> role GROUP BY p, role")
def role_network(spark, sf):
    """Turns of conversations as a second kind of series."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", F.col("turn").alias("ts"), F.lit(0).alias("ord"), F.col("role").alias("state"))
    return _round(sequences.transitions(c, ["conv_id"], []), "prob")


@query(f"WITH {EV} SELECT home, {', '.join(f'CAST(count(*) FILTER (sensor = {chr(39)}{s}{chr(39)}) AS BIGINT) AS {s}' for s in SENSORS)} FROM ev GROUP BY home")
def sensor_pivot(spark, sf):
    p = log(spark, sf).groupBy("home").pivot("sensor", SENSORS).agg(F.count(F.lit(1)))
    return p.fillna(0, SENSORS)


# Faults and invariants --------------------------------------------------------------------------------------------------

_CH = "(('0x' || substr(md5('7|{w}|' || ord), 1, 8))::BIGINT / 4294967296.0)"


@query(f"WITH {EV}, c AS (SELECT ord AS id, sensor, ts, bit, {_CH.format(w='drop')} AS dr, {_CH.format(w='flip')} < 0.05 AS fl, {_CH.format(w='delay')} < 0.1 AS de, {_CH.format(w='duplicate')} < 0.08 AS du FROM ev), k AS (SELECT id, sensor, CASE WHEN de THEN ts + to_microseconds(90000000) ELSE ts END AS ts, CASE WHEN fl THEN 1 - bit ELSE bit END AS bit, du, concat_ws('+', CASE WHEN fl THEN 'flip' END, CASE WHEN de THEN 'delay' END) AS fault FROM c WHERE dr >= 0.03) SELECT id, sensor, ts, bit, fault FROM k UNION ALL SELECT id, sensor, ts + to_microseconds(1), bit, concat_ws('+', CASE WHEN fault <> '' THEN fault END, 'duplicate') FROM k WHERE du")
def injected_faults(spark, sf):
    e = log(spark, sf).select(F.col("ord").alias("id"), "ts", "sensor", "bit")
    return faults.inject(e, 7, drop=0.03, flip=0.05, delay=0.1, delay_us=90_000_000, duplicate=0.08)


@query(f"WITH {EV} SELECT home, ts, ord, sensor, bit FROM (SELECT *, lag(bit) OVER (PARTITION BY home, sensor ORDER BY ts, ord) AS p FROM ev) WHERE p IS NULL OR p <> bit")
def without_repeats(spark, sf):
    return faults.without_repeats(log(spark, sf), ["home", "sensor"], "bit").select("home", "ts", "ord", "sensor", "bit")


@query(f"WITH {EV}, x AS (SELECT home, lag(ts) OVER (PARTITION BY home ORDER BY ord) > ts AS back, row_number() OVER (PARTITION BY home, ts, sensor, bit ORDER BY ord) > 1 AS again, sensor, ts, bit FROM ev) SELECT home, count(*) AS n_rows, count(*) FILTER (ts IS NULL OR sensor IS NULL OR bit IS NULL) AS empty_cells, count(*) FILTER (sensor NOT IN ('click', 'view')) AS unknown_sensors, count(*) FILTER (back) AS time_back, count(*) FILTER (again) AS duplicates FROM x GROUP BY home")
def invariants(spark, sf):
    return faults.violations(log(spark, sf), ["home"], ["click", "view"])


_HELD = ", ".join(f"last_value(CASE WHEN sensor = '{x}' THEN bit END IGNORE NULLS) OVER w AS {x}_" for x in SENSORS)
_OBJECT = ", ".join(f"CASE WHEN {x}_ IS NOT NULL THEN '\"{x}\":' || {x}_ END" for x in sorted(SENSORS))


@query(f"WITH {EV}, h AS (SELECT home, ts, ord, {_HELD} FROM ev WINDOW w AS (PARTITION BY home ORDER BY ts, ord ROWS UNBOUNDED PRECEDING)), s AS (SELECT home, ts, ord, '{{' || concat_ws(',', {_OBJECT}) || '}}' AS snapshot FROM h) SELECT home, ts, ord, snapshot FROM (SELECT *, lag(snapshot) OVER (PARTITION BY home ORDER BY ts, ord) AS p FROM s) WHERE p IS NULL OR p <> snapshot")
def snapshots(spark, sf):
    """Sensor states after each change, as JSON."""
    return sinks.snapshots(log(spark, sf), ["home"], SENSORS).select("home", "ts", "ord", "snapshot")


@query()
def network_json(spark, sf):
    """The daytime network as one JSON document."""
    e = log(spark, sf)
    edges = sequences.transitions(e, ["home", "band"], ["band"]).filter("band = 'Daytime'")
    held = sinks.minutes_per_day(sequences.intervals(e, ["home"]), [], 30)
    nodes = held.select(F.dense_rank().over(Window.orderBy("state")).alias("rank"), F.col("state").alias("state_id"), F.array("state").alias("active_sensors"), "avg_duration_minutes_per_day")
    return sinks.network_json(nodes, edges.withColumn("first_seen", F.concat("src", "dst")))
