"""Operators of evaluations that small tables show best: brute force and cases with expected values."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlog import functions as fn
from lumenlog.operators import evaluation, intervals, patterns, sequences, sinks


def ts(x):
    return F.col(x).cast("timestamp_ntz")


def test_undefined_truth_scores_nothing(spark):
    """A pattern that occurs without a truth is not evaluable, one that occurs nowhere scores 0 end to end."""
    pats = spark.createDataFrame([("P1", "G", "All", "a->b", ["Meal"], "valid"), ("P2", None, "All", "x->y", ["Meal"], "valid"), ("P3", None, "Morning", "c->d", ["Meal", "Relax"], "valid"), ("P4", None, "Morning", "c->d", [], "missing")], "pattern_id string, group_id string, band string, sequence string, labels array<string>, status string")
    occ = spark.createDataFrame([(None, 1, "a->b", "2024-01-01 23:59:00", "2024-01-02 00:01:00"), ("P3", 1, "c->d", "2024-01-01 07:00:00", "2024-01-01 08:00:00"), (None, 1, "c->d", "2024-01-01 09:30:00", "2024-01-01 10:30:00"), (None, 1, "c->d", "2024-01-01 09:00:00", "2024-01-01 10:00:00")], "pattern_id string, home int, sequence string, start_time string, end_time string").withColumns({c: ts(c) for c in ("start_time", "end_time")})
    truth = spark.createDataFrame([(1, "Meal", "2024-01-01 07:00:00", "2024-01-01 09:15:00")], "home int, category string, start_time string, end_time string").withColumns({c: ts(c) for c in ("start_time", "end_time")})
    got = {r.pattern_id: r for r in evaluation.interpretation_scores(pats, occ, truth, ["home"], 0.1).collect()}
    assert (got["P1"].truth_status, got["P1"].conditional_f1, got["P1"].end_to_end_f1, got["P1"].n_crossing) == ("no_adl_overlap", None, None, 1)
    assert (got["P2"].occurrence_status, got["P2"].conditional_f1, got["P2"].end_to_end_f1) == ("no_occurrence", None, 0.0)
    assert got["P3"].n_matching == 1 and got["P3"].conditional_precision == 0.5 and got["P3"].end_to_end_recall == 1.0
    assert got["P4"].n_matching == 3 and (got["P4"].n_crossing, got["P4"].n_occurrences) == (1, 2) and got["P4"].conditional_f1 == 0.0
    s = evaluation.summary(evaluation.interpretation_scores(pats, occ, truth, ["home"], 0.1), []).first()
    assert (s.n_patterns, s.n_conditional_evaluable, s.n_end_to_end_evaluable, s.occurrence_coverage) == (4, 2, 3, 0.75)


def test_greedy_matches_are_those_of_a_loop(spark):
    r = random.Random(3)
    pairs = [(g, p, t, r.choice([0.2, 0.5, 0.5, 0.9])) for g in range(5) for p in range(8) for t in range(8) if r.random() < 0.4]
    want, used = set(), set()
    for g, p, t, s in sorted(pairs, key=lambda x: (x[3], x[1], x[2]), reverse=True):
        if (g, "p", p) not in used and (g, "t", t) not in used:
            used |= {(g, "p", p), (g, "t", t)}
            want.add((g, p, t))
    got = intervals.greedy_match(spark.createDataFrame(pairs, "g int, p int, t int, s double"), ["g"], "p", "t", "s").collect()
    assert {(x.g, x.p, x.t) for x in got} == want and len(got) == len(want)


def test_nested_marks_pair_like_a_stack(spark):
    r = random.Random(5)
    rows = [(k, i, r.choice(["begin", "end"])) for k in range(6) for i in range(60)]
    want = set()
    for k in range(6):
        stack = []
        for _, i, kind in (x for x in rows if x[0] == k):
            if kind == "begin":
                stack.append(i)
            elif stack:
                want.add((k, stack.pop(), i))
    marks = spark.createDataFrame([(k, i, i, kind) for k, i, kind in rows], "k int, ord int, s int, kind string").withColumn("ts", F.timestamp_add("SECOND", F.col("s"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    got = intervals.pair_annotations(marks, ["k"]).select("k", *(F.second(c) for c in ("start_time", "end_time"))).collect()
    assert {tuple(x) for x in got} == want


def test_long_patterns_are_found(spark):
    states = list("abcdefgabcdeabxde")
    rows = [(1, i, s) for i, s in enumerate(states)]
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    series = spark.createDataFrame(rows, "home int, ord int, state string").withColumns({"start_time": F.timestamp_add("SECOND", F.col("ord"), at), "end_time": F.timestamp_add("SECOND", F.col("ord") + 1, at)})
    pats = spark.createDataFrame([("a->b->c->d->e",), ("a->b->c->d->e->f->g",), ("d->e",), ("a->b->d->e",)], "sequence string")
    got = sorted((r.sequence, r.start_time.second, r.end_time.second) for r in sequences.occurrences(series, ["home"], pats).collect())
    assert got == [("a->b->c->d->e", 0, 5), ("a->b->c->d->e", 7, 12), ("a->b->c->d->e->f->g", 0, 7), ("d->e", 3, 5), ("d->e", 10, 12), ("d->e", 15, 17)]
    skipping = sequences.occurrences(series, ["home"], pats, other="x", most_skip=5.0)
    assert {(r.sequence, r.start_time.second) for r in skipping.collect()} >= {("a->b->d->e", 12)}


def test_pairs_that_hold_each_other(spark):
    a, b = ([(x,) for x in t] for t in (["a->b", "a->b->c", "x"], ["b->c", "a->b->c->d", "b", "ab->c"]))
    got = patterns.holding_pairs(spark.createDataFrame(a, "sequence string"), spark.createDataFrame(b, "sequence string"))
    inside = lambda s, t: f"->{s}->" in f"->{t}->"
    assert sorted(map(tuple, got.collect())) == sorted((x, y) for (x,) in a for (y,) in b if inside(x, y) or inside(y, x))


def test_labels(spark):
    rows = spark.createDataFrame([("Wake_Up; SLEEP",), ('["Meal","fly","fly"]',), ("",), (None,), ("a/Work",)], "raw string").select(fn.label_values("raw").alias("v"))
    s = fn.label_sets(F.col("v"))
    got = [tuple(r) for r in rows.select(s["labels"], s["unknown"], s["status"]).collect()]
    assert got == [(["Sleep", "Wake-up"], [], "valid"), (["Meal"], ["fly"], "unknown"), ([], [], "missing"), ([], [], "missing"), (["Work"], ["a"], "unknown")]
    numbers = spark.createDataFrame([("1.5",), (" 2 ",), ("nan",), ("inf",), ("x",), (None,)], "t string").select(fn.number("t").alias("n")).collect()
    assert [r.n for r in numbers] == [1.5, 2.0, None, None, None, None]
    low = spark.createDataFrame([(["a", "b"], {"a": True}), ], "s array<string>, m map<string,boolean>")
    with pytest.raises(Exception, match="no attribute"):
        low.select(fn.low_information("s", [], F.col("m"))).collect()


def test_keys_that_come_twice_fail(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert intervals.many_to_one(a, b, ["k"]).count() == 3
    with pytest.raises(Exception, match="twice"):
        intervals.many_to_one(a, b.unionAll(b.filter("k = 1")), ["k"]).collect()


def test_shared_seconds_within_a_domain(spark):
    at = lambda c: F.timestamp_add("SECOND", F.col(c), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    spans = lambda rows: spark.createDataFrame(rows, "home int, category string, a int, b int").select("home", "category", at("a").alias("start_time"), at("b").alias("end_time"))
    p, t, d = spans([(1, "Meal", 0, 100), (1, "Meal", 50, 150), (2, "Work", 0, 10)]), spans([(1, "Meal", 100, 200), (1, "Relax", 0, 50)]), spans([(1, "x", 0, 120), (2, "x", 5, 10)])
    got = {r.category: (r.tp, r.predicted, r.true) for r in intervals.category_seconds(p, t, ["home"]).collect()}
    assert got == {"Meal": (50.0, 150.0, 100.0), "Work": (0.0, 10.0, 0.0), "Relax": (0.0, 0.0, 50.0)}
    got = {r.category: (r.tp, r.predicted, r.true) for r in intervals.category_seconds(p, t, ["home"], d.drop("category")).collect()}
    assert got == {"Meal": (20.0, 120.0, 20.0), "Work": (0.0, 5.0, 0.0), "Relax": (0.0, 0.0, 50.0)}


def test_state_tables_and_sequences_as_files(spark, tmp_path):
    states = spark.createDataFrame([(2, "S2", 2), (1, "S1", 3)], "rank int, state_id string, mask long")
    sinks.state_table_tsv(states, ["A", "B"], f"{tmp_path}/t")
    rows = spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/t").collect()
    assert [tuple(r) for r in rows] == [("S1", "1", "1"), ("S2", "0", "1"), (fn.OTHER, "-", "-")]
    sinks.sequences_json(spark.createDataFrame([("a->b", 1), ("b->c", 3)], "sequence string, cnt int"), f"{tmp_path}/j", [F.desc("cnt")], 1)
    assert [r.sequence for r in spark.read.json(f"{tmp_path}/j").collect()] == ["b->c"]


def test_scopes_by_flag_or_by_value(spark):
    rows = spark.createDataFrame([(0.5, 0.5, 1, 0), (None, 0.0, 0, 1), (0.9, 0.9, None, None)], "conditional_f1 double, end_to_end_f1 double, is_metric_evaluable int, is_end_to_end_evaluable int")
    of = lambda df: [tuple(r) for r in df.select(*(evaluation.evaluable(df, s) for s in evaluation.SCOPES)).collect()]
    assert of(rows) == [(True, False), (False, True), (False, False)]
    assert of(rows.drop("is_metric_evaluable", "is_end_to_end_evaluable")) == [(True, True), (False, True), (True, True)]
    plain = rows.select(F.col("conditional_f1").alias("f1"))
    assert of(plain) == [(True, True), (False, False), (True, True)]


def test_pairs_with_truths_are_not_shuffled_one_by_one(spark):
    import re

    from lumenlog.operators import patterns

    at = lambda c: F.timestamp_add("SECOND", F.col(c), F.lit("2024-01-01").cast("timestamp_ntz"))
    spans = lambda x, schema: spark.createDataFrame(x, schema).withColumns({"start_time": at("a"), "end_time": at("b")}).drop("a", "b")
    occ = spans([("x", 1, 0, 100), ("x", 1, 50, 250), ("y", 1, 300, 400), ("y", 2, 0, 100)], "sequence string, home int, a int, b int")
    truth = spans([(1, c, i, 200 + i) for c in ("Meal", "Work") for i in range(20)] + [(2, "Work", 40, 60)], "home int, category string, a int, b int")
    assigned = spark.createDataFrame([("x", ["Meal"]), ("y", ["Meal", "Relax"])], "sequence string, labels array<string>")
    got = patterns.truth_shares(occ, truth, assigned, ["home"], ["sequence"], 60.0)
    assert sorted(map(tuple, got.collect())) == [("x", 2, 1.0, 269 / 300, 1.0, 269 / 300), ("y", 2, 0.0, 0.0, 0.0, 0.1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Window \[.*\], \[_id#", plan)) == 2  # the own categories' only
