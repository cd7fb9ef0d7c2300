"""Further queries: patterns over bands, fragments, quality, boundaries, rollups, ratings, splits, modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog import functions as fn
from lumenlog.functions import OTHER
from lumenlog.operators import intervals, patterns, scoring, sequences, stats
from lumenlog.plans.adapter import EV, INTERVAL_TABLES, SPLIT, log, predictions, runs_sql, truths
from lumenlog.plans.queries import _DAYS, _IOU, _IV, _OV, _SETS, _TOP10, _grams_sql, _holdout, _round, _runs, _span_grams, _top_spans, query


@query(f"WITH {INTERVAL_TABLES}, p AS (SELECT a.category, (epoch_us(a.start_time) - epoch_us(b.start_time)) / 1e6 AS s, (epoch_us(a.end_time) - epoch_us(b.end_time)) / 1e6 AS e, {_IOU} AS iou FROM pr AS a JOIN tr AS b ON a.home = b.home AND a.start_time < b.end_time AND b.start_time < a.end_time) SELECT category, count(*) AS n, round(avg(s), 3) AS start_mean, round(quantile_cont(abs(s), 0.5), 3) AS start_median_abs, round(avg(e), 3) AS end_mean, round(quantile_cont(abs(e), 0.5), 3) AS end_median_abs, round(avg(iou), 6) AS mean_iou FROM p GROUP BY category")
def boundary_errors(spark, sf):
    """How far the ends of overlapping predictions and truths of a home lie apart."""
    e = log(spark, sf)
    p = intervals.iou_pairs(predictions(e).drop("ord"), truths(e).drop("ord", "category"), ["home"], 0.0)
    out = intervals.boundary_errors(p, ["category"])
    return _round(_round(out, "start_mean", "start_median_abs", "end_mean", "end_median_abs", digits=3), "mean_iou")


@query(f"WITH {INTERVAL_TABLES}, m AS (SELECT category, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 >= CASE category WHEN 'Sleeping' THEN 1800 WHEN 'Meal_Preparation' THEN 600 ELSE 300 END AS ok FROM pr) SELECT category, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS removed FROM m GROUP BY category")
def minimum_durations(spark, sf):
    """Predictions that last as long as their category has to."""
    return intervals.long_enough(predictions(log(spark, sf)), {"Sleeping": 1800.0, "Meal_Preparation": 600.0}, 300.0, [])[1]


@query(f"WITH {_SETS}, r AS (SELECT home % 2 AS method, home % 5 + 1 AS run, avg(b / (np + nt - b)) AS jaccard, avg(2.0 * b / (np + nt)) AS f1 FROM sm GROUP BY ALL) SELECT coalesce(method, -1) AS method, coalesce(run, -1) AS run, round(avg(jaccard), 6) AS jaccard, round(avg(f1), 6) AS f1, count(*) AS n FROM r GROUP BY ROLLUP (method, run)")
def run_rollup(spark, sf):
    """Means of runs, of methods, and of all (-1)."""
    return _round(_runs(spark, sf).rollup("method", "run").agg(F.avg("jaccard").alias("jaccard"), F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n")), "jaccard", "f1").fillna(-1, ["method", "run"])


@query(f"WITH {_SETS}, r AS (SELECT home % 2 AS method, home % 5 + 1 AS run, round(avg(b / (np + nt - b)), 6) AS jaccard, round(avg(2.0 * b / (np + nt)), 6) AS f1 FROM sm GROUP BY ALL) SELECT method, run, jaccard, f1, CAST(row_number() OVER (ORDER BY f1 DESC, jaccard DESC, method, run) AS INTEGER) AS rank FROM r")
def ranked_conditions(spark, sf):
    return patterns.ranked(_round(_runs(spark, sf), "jaccard", "f1"), ["f1", "jaccard"], ["method", "run"])


_BANDED = f"{EV}, {runs_sql('home, date, band')}, {_grams_sql('home, date, band', 2, 4)}, t AS (SELECT band, sequence, n, count(*) AS cnt, min(ROW(ts, ord)) AS f FROM g GROUP BY ALL), bp AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY band ORDER BY cnt DESC, n, f, sequence) <= 15)"


def _banded(spark, sf) -> DataFrame:
    return sequences.top_patterns(sequences.ngram_counts(log(spark, sf), ["home", "date", "band"], ["band"]), ["band"], 15)


@query(f"WITH {_BANDED}, m AS (SELECT sequence, min(f) AS f, string_agg(DISTINCT band, '|' ORDER BY band) AS bands FROM bp GROUP BY sequence) SELECT 'P' || lpad(CAST(row_number() OVER (ORDER BY f, sequence) AS VARCHAR), 3, '0') AS pattern_id, sequence, bands FROM m")
def merged_patterns(spark, sf):
    """Patterns of all bands as one list."""
    return patterns.merge_bands(_banded(spark, sf))


@query(f"WITH {_BANDED} SELECT c.band, c.sequence, count(p.sequence) AS n_parents, CAST(count(p.sequence) > 0 AS INTEGER) AS fragmented FROM bp AS c LEFT JOIN bp AS p ON c.band = p.band AND p.n > c.n AND contains('->' || p.sequence || '->', '->' || c.sequence || '->') GROUP BY c.band, c.sequence")
def pattern_fragments(spark, sf):
    """Patterns that stand in longer ones of their band."""
    return patterns.fragments(_banded(spark, sf), ["band"])


@query(f"WITH {_IV}, {_span_grams(4)}, {_TOP10}, o AS (SELECT home, sequence, start_time, end_time FROM g WHERE sequence IN (SELECT sequence FROM tp)) SELECT home, sequence, start_time, end_time, sequence || '_' || lpad(CAST(row_number() OVER (PARTITION BY sequence ORDER BY start_time, home) AS VARCHAR), 4, '0') AS occurrence_id FROM o")
def numbered_occurrences(spark, sf):
    held = sequences.intervals(log(spark, sf), ["home"])
    return patterns.number_occurrences(sequences.occurrences(held, ["home"], _top_spans(held)), "sequence", ["start_time", "home"])


@query(f"WITH {_IV}, {_span_grams(4)}, {_TOP10}, o AS (SELECT home, sequence, start_time FROM g WHERE sequence IN (SELECT sequence FROM tp)) SELECT home, start_time, min(sequence) AS owner, count(*) AS claims FROM o GROUP BY home, start_time")
def occurrence_owners(spark, sf):
    """Which pattern owns the occurrences that start at one place."""
    held = sequences.intervals(log(spark, sf), ["home"])
    return patterns.owners(sequences.occurrences(held, ["home"], _top_spans(held)), ["home", "start_time"], "sequence")


@query(f"WITH {INTERVAL_TABLES}, x AS (SELECT a.category, sum({_OV}) AS s FROM pr AS a JOIN tr AS b ON a.home = b.home AND a.start_time < b.end_time AND b.start_time < a.end_time GROUP BY a.category), p AS (SELECT category, sum((epoch_us(end_time) - epoch_us(start_time)) / 1e6) AS s FROM pr GROUP BY category), t AS (SELECT category, sum((epoch_us(end_time) - epoch_us(start_time)) / 1e6) AS s FROM tr GROUP BY category) SELECT p.category, round(coalesce(x.s, 0.0), 3) AS shared_seconds, round(p.s, 3) AS predicted_seconds, round(t.s, 3) AS true_seconds FROM p JOIN t USING (category) LEFT JOIN x USING (category)")
def seconds_by_category(spark, sf):
    """Time that predictions share with any truth of the home, and the time of both sides."""
    e = log(spark, sf)
    p, t, length = predictions(e), truths(e), F.sum(fn.seconds_between("start_time", "end_time"))
    x = intervals.overlap_join(p, t, ["home"]).groupBy("category").agg(F.sum("overlap").alias("shared_seconds"))
    out = p.groupBy("category").agg(length.alias("predicted_seconds")).join(t.groupBy("category").agg(length.alias("true_seconds")), "category").join(x, "category", "left").fillna(0.0, ["shared_seconds"])
    return _round(out, "shared_seconds", "predicted_seconds", "true_seconds", digits=3)


@query(f"WITH {_DAYS}, pe AS (SELECT band, sequence FROM (SELECT band, sequence, row_number() OVER (PARTITION BY band ORDER BY count(*) DESC, sequence) AS r FROM te GROUP BY band, sequence) WHERE r <= 10), k AS (SELECT coalesce(pt.band, pe.band) AS band, count(*) FILTER (pt.band IS NOT NULL AND pe.band IS NOT NULL) AS tp, count(*) FILTER (pe.band IS NULL) AS fp, count(*) FILTER (pt.band IS NULL) AS fn FROM pt FULL JOIN pe ON pt.band = pe.band AND pt.sequence = pe.sequence GROUP BY 1) SELECT band, tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k")
def exact_pattern_scores(spark, sf):
    """The ten most frequent sequences before the split against those after it."""
    train, _, test = _holdout(spark, sf)
    top = test.groupBy("band", "sequence").agg(F.count(F.lit(1)).alias("c"))
    gold = top.withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("c"), "sequence"))).filter("r <= 10")
    return _round(patterns.key_scores(gold, train, ["sequence"], ["band"]), "f1")


@query(f"WITH {EV}, s AS (SELECT home, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM ev GROUP BY home), d AS (SELECT home, a, CAST(b - a + 1 AS INTEGER) AS n_days FROM s), t AS (SELECT *, greatest(1, least(n_days - 1, CAST(floor(n_days * 0.7) AS INTEGER))) AS train_days FROM d) SELECT home, n_days, train_days, CAST(CAST(a + train_days AS DATE) AS VARCHAR) AS split FROM t")
def split_days(spark, sf):
    """Seven tenths of each home's days, in whole days."""
    return patterns.split_days(log(spark, sf), ["home"], 0.7).withColumn("split", F.col("split").cast("string"))


@query(f"WITH {EV}, t AS (SELECT ord, sensor, band, CAST(row_number() OVER (PARTITION BY sensor, band ORDER BY md5('5|' || ord)) AS INTEGER) AS turn FROM ev) SELECT ord, sensor, band, turn FROM t ORDER BY turn, sensor, band LIMIT 60")
def blind_sample(spark, sf):
    """Sixty events that take turns over sensors and bands."""
    return patterns.round_robin(log(spark, sf), ["sensor", "band"], "ord", 5, 60).select("ord", "sensor", "band", "turn")


@query("WITH u AS (SELECT l_returnflag AS method, criterion, value FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax FROM lineitem) UNPIVOT (value FOR criterion IN (quantity, discount, tax))) SELECT method, criterion, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM u GROUP BY method, criterion")
def ratings(spark, sf):
    """Three columns as ratings of a method: count, mean and deviation of each."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("method"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"))
    return _round(scoring.ratings(l, ["method"], ["quantity", "discount", "tax"]), "mean", "sd")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def keyed_join(spark, sf):
    """Many rows to one key row."""
    o, c = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    both = intervals.many_to_one(o, c.withColumnRenamed("c_custkey", "o_custkey").select("o_custkey", "c_mktsegment"), ["o_custkey"])
    return _round(both.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)


@query(f"WITH {EV} SELECT sensor, count(*) FILTER (hour(ts) >= 6 AND hour(ts) < 10) AS morning, count(*) FILTER (hour(ts) < 4) AS late FROM ev GROUP BY sensor")
def time_modes(spark, sf):
    """Events of a mode; one whose end is before its start keeps what lies before its end, as such logs are cut."""
    e = log(spark, sf)
    n, every = F.count(F.lit(1)), e.select("sensor").distinct()
    morning = intervals.in_mode(e, "06:00", "10:00").groupBy("sensor").agg(n.alias("morning"))
    late = intervals.in_mode(e, "22:00", "04:00").groupBy("sensor").agg(n.alias("late"))
    return every.join(morning, "sensor", "left").join(late, "sensor", "left").fillna(0)


_HALF = f"{EV}, s AS (SELECT *, lead(ts) OVER (PARTITION BY home ORDER BY ts, ord) AS nt, lead(sensor) OVER (PARTITION BY home ORDER BY ts, ord) AS ns, max(ts) OVER (PARTITION BY home) AS last FROM ev WHERE sensor IN ('signup', 'purchase'))"


@query(f"WITH {_HALF} SELECT home, ts AS start_time, CASE WHEN ns = 'purchase' THEN nt ELSE last END AS end_time, coalesce(ns = 'purchase', false) AS complete FROM s WHERE sensor = 'signup'")
def activity_truth(spark, sf):
    """Starts with the end that follows them; others are open, and closed at the home's last mark."""
    m = log(spark, sf).filter(F.col("sensor").isin("signup", "purchase")).withColumn("kind", F.when(F.col("sensor") == "signup", "begin").otherwise("end"))
    return intervals.activity_truth(m, ["home"])


@query(f"WITH {_IV}, d AS (SELECT home, state, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS s FROM iv) SELECT home, count(*) AS n_intervals, count(*) FILTER (state = '{OTHER}') AS n_other, round(coalesce(sum(s) FILTER (state = '{OTHER}'), 0) / sum(s), 6) AS other_ratio FROM d GROUP BY home")
def series_summary(spark, sf):
    """Intervals of each home, and how much of them is unmapped."""
    s, other = fn.seconds_between("start_time", "end_time"), F.col("state") == OTHER
    held = sequences.intervals(log(spark, sf), ["home"])
    return _round(held.groupBy("home").agg(F.count(F.lit(1)).alias("n_intervals"), F.count_if(other).alias("n_other"), (F.coalesce(F.sum(F.when(other, s)), F.lit(0.0)) / F.sum(s)).alias("other_ratio")), "other_ratio")


@query(f"WITH {EV}, {runs_sql('home')}, {_grams_sql('home', 2, 4)}, t AS (SELECT sequence, count(*) AS cnt, string_split(sequence, '->') AS x FROM g GROUP BY sequence) SELECT sequence, cnt, round(len(list_filter(x, lambda s: s = '{OTHER}' OR s = 'view')) / len(x), 6) AS low_information FROM t")
def low_information(spark, sf):
    """Share of a sequence's states that say little."""
    c = sequences.ngram_counts(log(spark, sf), ["home"], []).withColumn("x", F.split("sequence", fn.ARROW))
    return _round(c.select("sequence", "cnt", fn.low_information("x", [OTHER, "view"]).alias("low_information")), "low_information")


@query(f"WITH {INTERVAL_TABLES}, m(category, extra) AS (VALUES ('Sleeping', 'Wake_Up'), ('Eating', 'Meal_Preparation'), ('Meal_Preparation', 'Eating')), e AS (SELECT home, ord, category FROM tr UNION ALL SELECT home, ord, extra FROM tr JOIN m USING (category)) SELECT category, count(*) AS n FROM e GROUP BY category")
def expanded_labels(spark, sf):
    """Each label interval once for every category that it may stand for."""
    also = spark.createDataFrame([("Sleeping", ["Wake_Up"]), ("Eating", ["Meal_Preparation"]), ("Meal_Preparation", ["Eating"])], "label string, categories array<string>")
    return intervals.expanded(truths(log(spark, sf)).withColumn("label", F.col("category")), also).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT conv_id % 7 AS model, conv_id % 3 AS run, CASE WHEN turn = 3 AND conv_id % 11 = 0 THEN NULL ELSE strlen(text) END AS a, strlen(role) AS b FROM conversations) SELECT model, run, count(*) AS n_calls, CAST(sum(a) AS BIGINT) AS input_tokens, CAST(sum(b) AS BIGINT) AS output_tokens, CAST(count(*) FILTER (a IS NULL OR b IS NULL) = 0 AND count(*) = 25 AS INTEGER) AS complete FROM c GROUP BY model, run")
def usage_totals(spark, sf):
    """Calls and tokens of runs, complete where 25 calls have all fields."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    a = F.when((F.col("turn") == 3) & (F.col("conv_id") % 11 == 0), None).otherwise(F.octet_length("text"))
    return stats.usage_totals(c.select((F.col("conv_id") % 7).alias("model"), (F.col("conv_id") % 3).alias("run"), a.alias("input_tokens"), F.octet_length("role").alias("output_tokens")), ["model", "run"], 25)


@query(f"WITH {EV}, g AS (SELECT home, d.date, h.h FROM (SELECT DISTINCT home FROM ev) AS x, (SELECT DISTINCT date FROM ev) AS d, range(0, 24) AS h(h)), s AS (SELECT home, CAST(date AS TIMESTAMP) + to_hours(CAST(h + 1 AS INTEGER)) AS t, date, CAST(h AS INTEGER) AS hour FROM g) SELECT s.home, CAST(s.date AS VARCHAR) AS date, s.hour, a.state FROM s ASOF JOIN (SELECT home, ts, arg_max(state, ord) AS state FROM ev GROUP BY home, ts) AS a ON s.home = a.home AND s.t > a.ts")
def timeline(spark, sf):
    """The last state of each home before the end of every hour, days before included."""
    e = log(spark, sf)
    out = intervals.timeline(e, ["home"], e.select("date").distinct(), 3600)
    return out.select("home", F.col("date").cast("string").alias("date"), F.hour("at").alias("hour"), "state")


def _listed_sql(name: str, where: str) -> str:
    return f"{name}r AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY home ORDER BY ts, ord) AS _p FROM ev WHERE {where}) WHERE _p IS NULL OR _p <> state), {_grams_sql('home', 2, 4, name + 'r').replace('a AS (', name + 'a AS (', 1).replace('g AS (', name + 'g AS (', 1).replace('FROM a', f'FROM {name}a')}, {name} AS (SELECT sequence, CAST(row_number() OVER (ORDER BY c DESC, sequence) AS INTEGER) AS place FROM (SELECT sequence, count(*) AS c FROM {name}g GROUP BY sequence ORDER BY c DESC, sequence LIMIT 120))"


@query(f"""WITH RECURSIVE {EV}, {_listed_sql("x", f"ts < TIMESTAMP '{SPLIT}'")}, {_listed_sql("y", f"ts >= TIMESTAMP '{SPLIT}'")},
c AS (SELECT x.place AS p, list(y.place ORDER BY y.place) FILTER (y.place IS NOT NULL) AS ts FROM x LEFT JOIN y ON x.sequence = y.sequence OR contains('->' || x.sequence || '->', '->' || y.sequence || '->') GROUP BY x.place),
m AS (SELECT 0 AS p, [] :: INTEGER[] AS taken, NULL :: INTEGER AS truth UNION ALL SELECT c.p, CASE WHEN len(l.f) > 0 THEN list_append(m.taken, l.f[1]) ELSE m.taken END, l.f[1] FROM m JOIN c ON c.p = m.p + 1, LATERAL (SELECT list_filter(coalesce(c.ts, []), lambda t: NOT list_contains(m.taken, t)) AS f) AS l)
SELECT p AS prediction, truth, x.sequence, y.sequence AS gold_sequence FROM m JOIN x ON x.place = p JOIN y ON y.place = truth""")
def listed_matches(spark, sf):
    """Frequent sequences of two halves of the log matched in list order; a prediction may hold what it matches."""
    return patterns.listed_matches(*_two_lists(spark, sf), [], a_may_hold=True)[0]


def _two_lists(spark, sf) -> list[DataFrame]:
    e, split, out = log(spark, sf), F.lit(SPLIT).cast("timestamp_ntz"), []
    for half in (e.filter(F.col("ts") < split), e.filter(F.col("ts") >= split)):
        top = sequences.ngram_counts(half, ["home"], []).groupBy("sequence").agg(F.sum("cnt").alias("c")).orderBy(F.desc("c"), "sequence").limit(120)
        out.append(top.select("sequence", F.row_number().over(Window.orderBy(F.desc("c"), "sequence")).alias("place")))  # 120 rows
    return out


@query(f"""WITH {EV}, {_listed_sql("x", f"ts < TIMESTAMP '{SPLIT}'")}, {_listed_sql("y", f"ts >= TIMESTAMP '{SPLIT}'")}, k AS (SELECT count(*) FILTER (x.place IS NOT NULL AND y.place IS NOT NULL) AS tp, count(*) FILTER (y.place IS NULL) AS fp, count(*) FILTER (x.place IS NULL) AS fn FROM x FULL JOIN y USING (sequence))
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k""")
def listed_scores(spark, sf):
    """Scores of the same lists where only equal sequences match."""
    return _round(patterns.listed_matches(*_two_lists(spark, sf), [])[1], "precision", "recall", "f1")
