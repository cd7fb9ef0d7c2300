from datetime import datetime

from pyspark.sql import functions as F

from lumenlog.functions import OTHER
from lumenlog.operators import faults, intervals, scoring, sequences, sinks, stats, vectors


def t(text):
    return datetime.fromisoformat(f"2024-01-01 {text}" if len(text) <= 15 else text)


def series(spark, states, home=1):
    rows = [(home, t(f"00:{i // 60:02d}:{i % 60:02d}"), i, s) for i, s in enumerate(states.split())]
    return spark.createDataFrame(rows, "home int, ts timestamp_ntz, ord int, state string")


def spans(spark, rows, names="home int, category string, start_time timestamp_ntz, end_time timestamp_ntz"):
    return spark.createDataFrame(rows, names)


def test_transitions_and_durations(spark):
    s = series(spark, "A A B A C")
    got = {(r.src, r.dst): (r.cnt, r.prob) for r in sequences.transitions(s, ["home"], []).collect()}
    assert got == {("A", "B"): (1, 0.5), ("B", "A"): (1, 1.0), ("A", "C"): (1, 0.5)}
    assert {r.state: r.seconds for r in sequences.durations(s, ["home"], []).collect()} == {"A": 3.0, "B": 1.0, "C": 1.0}


def test_empty_and_null_series(spark):
    empty = series(spark, "")
    assert sequences.transitions(empty, ["home"], []).count() == 0
    nulls = spark.createDataFrame([(1, t("00:00:00"), 0, None), (1, t("00:00:01"), 1, "A"), (1, t("00:00:02"), 2, "A")], "home int, ts timestamp_ntz, ord int, state string")
    assert [r.state for r in sequences.runs(nulls, ["home"]).orderBy("ord").collect()] == ["A"]


def test_ngram_ties_go_to_the_first_seen(spark):
    top = sequences.top_patterns(sequences.ngram_counts(series(spark, "1 2 3 1 2 3 4"), ["home"], []), [], 3).collect()
    assert (top[0].sequence, top[0].cnt) == ("1->2", 2) and [r.sequence for r in top] == ["1->2", "2->3", "1->2->3"]


def test_paths_with_and_without_return(spark):
    e = spark.createDataFrame([("A", "B", 0.5), ("B", "A", 1.0), ("B", "C", 0.4)], "src string, dst string, prob double")
    assert {r.sequence for r in sequences.paths(e, [], 2, 3, 0.0, revisit=False).collect()} == {"A->B", "B->A", "B->C", "A->B->C"}
    assert {r.sequence for r in sequences.paths(e, [], 3, 3, 0.0, revisit=True).collect()} == {"A->B->A", "A->B->C", "B->A->B"}


def test_sample_and_hold(spark):
    rows = [(1, t("2023-12-31 23:59:59.500000"), 0, "Kitchen", 1), (1, t("00:00:00.100000"), 1, "Bedroom", 1), (1, t("00:00:00.900000"), 2, "Bedroom", 0), (1, t("00:00:02"), 3, "Kitchen", 0), (1, t("00:00:02"), 4, "Kitchen", 1)]
    e = spark.createDataFrame(rows, "home int, ts timestamp_ntz, ord int, sensor string, bit int")
    held = vectors.sample_and_hold(e, ["home"], ["Kitchen", "Bedroom"], "2024-01-01 00:00:00", 1, 4)
    assert [r["mask"] for r in held.orderBy("ts").collect()] == [1, 1, 1, 1]


def test_network_intervals(spark):
    rows = [(1, t("00:00:01.200000"), 0, "Kitchen", 1), (1, t("00:00:03"), 1, "Kitchen", 0), (1, t("00:00:10"), 2, "Kitchen", 1), (1, t("00:00:11"), 3, "Kitchen", 0)]
    e = spark.createDataFrame(rows, "home int, ts timestamp_ntz, ord int, sensor string, bit int")
    got = [(r.start_time.second, r.end_time.second, r["mask"]) for r in vectors.network_intervals(e, ["home"], ["Kitchen"], 1, 5).orderBy("start_time").collect()]
    assert got == [(0, 2, 0), (2, 7, 1), (7, 10, 0), (10, 15, 1), (15, 0, 0)]


def test_nearest_states(spark):
    v = spark.createDataFrame([(0b01,), (0b11,), (0b10,)], "mask long")
    states = spark.createDataFrame([(1, "S1", 0b01)], "rank int, state_id string, mask long")
    assert [r.state for r in vectors.nearest_states(v, states, 0).orderBy("mask").collect()] == ["S1", OTHER, OTHER]
    two = states.unionAll(spark.createDataFrame([(2, "S2", 0b10)], states.schema))
    assert {r["mask"]: r.state for r in vectors.nearest_states(v, two, 1).collect()}[0b11] == "S1"


def test_pairs_of_marks(spark):
    rows = [(1, t("00:00:00"), 0, "end"), (1, t("00:00:01"), 1, "begin"), (1, t("00:00:02"), 2, "begin"), (1, t("00:00:03"), 3, "end"), (1, t("00:00:05"), 4, "end"), (1, t("00:00:06"), 5, "begin")]
    m = spark.createDataFrame(rows, "home int, ts timestamp_ntz, ord int, kind string")
    got = [(r.start_time.second, r.end_time.second) for r in intervals.pair_annotations(m, ["home"]).orderBy("start_time").collect()]
    assert got == [(1, 5), (2, 3)]


def test_merging(spark):
    rows = [(1, "Relax", t("10:00:00"), t("10:01:00")), (1, "Relax", t("10:01:20"), t("10:02:00")), (1, "Relax", t("10:02:30"), t("10:03:20"))]
    got = intervals.merge_gaps(spans(spark, rows), ["home", "category"], 60.0).collect()
    assert len(got) == 1 and got[0].n == 3 and got[0].end_time == t("10:03:20")
    assert intervals.merge_gaps(spans(spark, rows), ["home", "category"], 0.0).count() == 3


def test_overlap_join_counts_a_pair_once(spark):
    long = spans(spark, [(1, "A", t("2024-01-01 00:00:00"), t("2024-01-04 00:00:00"))])
    got = intervals.overlap_join(long, long, ["home"]).collect()
    assert len(got) == 1 and got[0].overlap == 3 * 86400.0
    near = intervals.overlap_join(spans(spark, [(1, "A", t("05:59:00"), t("05:59:30"))]), spans(spark, [(1, "A", t("06:00:10"), t("06:01:00"))]), ["home"], tolerance=60.0).collect()
    assert len(near) == 1 and near[0].overlap == 0.0


def test_greedy_match(spark):
    p = spark.createDataFrame([(1, 1, 7, 0.9), (1, 2, 7, 0.8)], "home int, prediction int, truth int, iou double")
    assert [(r.prediction, r.truth) for r in intervals.greedy_match(p, ["home"], "prediction", "truth", "iou").collect()] == [(1, 7)]


def test_containment_and_relabelling(spark):
    parents = spans(spark, [(1, "P", t("10:00:00"), t("11:00:00"))])
    children = spans(spark, [(1, "C", t("10:10:00"), t("10:20:00")), (1, "C", t("10:50:00"), t("11:10:00"))])
    assert [r.inside for r in intervals.contained(children, parents, ["home"]).orderBy("start_time").collect()] == [True, False]
    rows = spans(spark, [(1, "Sleeping", t("01:00:00"), t("06:00:00")), (1, "Toilet", t("06:10:00"), t("06:12:00")), (1, "Meal", t("08:00:00"), t("08:30:00"))])
    got = intervals.relabel_after(rows, ["home"], F.col("category") == "Sleeping", "Wake", 1800.0).orderBy("start_time").collect()
    assert [r.category for r in got] == ["Sleeping", "Wake", "Meal"]


def test_tertiles_and_weighted_means(spark):
    rows = spark.createDataFrame([("P3", 1), ("P1", 1), ("P2", 1), ("P4", 4), ("P5", 5)], "id string, n int").withColumn("part", F.lit(1))
    assert {r.id: r.frequency_band for r in scoring.tertiles(rows, ["part"], ["n", "id"]).collect()} == {"P1": "Low", "P2": "Low", "P3": "Middle", "P4": "Middle", "P5": "High"}
    w = spark.createDataFrame([(1, 1, 0.0), (1, 9, 1.0), (2, 0, None)], "part int, n int, m double")
    assert [(r["mean"], r.weighted_mean, r.n_evaluable) for r in scoring.weighted_summary(w, ["part"], "m", "n").orderBy("part").collect()] == [(0.5, 0.9, 2), (None, None, 0)]


def test_deviation_of_one_run(spark):
    r = spark.createDataFrame([("m", 0.5)], "method string, f1 double")
    assert scoring.over_runs(r, ["method"], ["f1"]).first().f1_sd == 0.0
    assert scoring.over_runs(r, ["method"], ["f1"], single=None).first().f1_sd is None


def test_occurrences_that_skip(spark):
    rows = [(1, 0, t("10:00:00"), t("10:01:00"), "A"), (1, 1, t("10:01:00"), t("10:01:05"), OTHER), (1, 2, t("10:01:05"), t("10:02:00"), "B")]
    held = spark.createDataFrame(rows, "home int, ord int, start_time timestamp_ntz, end_time timestamp_ntz, state string")
    pats = spark.createDataFrame([("A->B",)], "sequence string")
    assert sequences.occurrences(held, ["home"], pats).count() == 0
    assert sequences.occurrences(held, ["home"], pats, OTHER, 5.0).count() == 1
    assert sequences.occurrences(held, ["home"], pats, OTHER, 4.0).count() == 0


def test_faults_do_not_depend_on_partitions(spark):
    e = spark.range(500).select(F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit("s").alias("sensor"), (F.col("id") % 2).cast("int").alias("bit"))
    a, b = (faults.inject(x, 3, 0.1, 0.1, 0.1, 1000, 0.1).select("id", "ts", "bit", "fault") for x in (e.repartition(1), e.repartition(7)))
    assert sinks.fingerprint(a, a.columns).collect() == sinks.fingerprint(b, b.columns).collect()


def test_divergence_of_equal_histograms(spark):
    a = spark.createDataFrame([(1, 2), (2, 2)], "k int, n int")
    b = spark.createDataFrame([(3, 5)], "k int, n int")
    assert stats.divergence(a, a, "k").first().js == 0.0 and round(stats.divergence(a, b, "k").first().js, 9) == 1.0
