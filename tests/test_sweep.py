"""Conditions in one plan give what each gives alone."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import OTHER
from lumenlog.operators import evaluation, intervals, sequences, vectors
from lumenlog.plans import evaluations

START = "2024-01-01"


def vectors_of(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), i * 1800, i, rng.choice([0, 1, 1, 2, 3, 3, 3, 6, 7, 12, 15])) for i in range(n)]
    return spark.createDataFrame(rows, "home int, s int, ord long, mask long").withColumn("ts", F.timestamp_add("SECOND", F.col("s"), F.lit(START).cast("timestamp_ntz"))).drop("s")


def rows(df):
    return sorted(map(str, df.collect()))


def test_sweep_is_each_condition_alone(spark):
    v, order = vectors_of(spark), ("ts", "ord", "home")
    conditions = [(k, h) for k in (1, 3, 50) for h in (0, 1, 4)]
    got = evaluation.swept(v, conditions + conditions[:2], order)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == len(conditions) * v.count() and plan.count("Scan ExistingRDD") <= 3  # whatever the number of conditions
    for k, h in conditions:
        alone = vectors.nearest_states(v, vectors.representative_states(v, k, order), h)
        one = got.filter((F.col("n_states") == k) & (F.col("threshold") == h))
        assert rows(one.select("home", "ts", "ord", "mask", "state")) == rows(alone.select("home", "ts", "ord", "mask", "state"))


def inputs(spark):
    v = vectors_of(spark)
    series = sequences.intervals(evaluation.swept(v, [(3, 0), (5, 1)], ("ts", "ord", "home")), ["n_states", "threshold", "home"])
    rng = random.Random(4)
    known = []
    for k, h in ((3, 0), (5, 1)):
        for run in (1, 2):
            for i in range(8):
                p = "->".join(rng.choice(["S1", "S2", "S3", OTHER]) for _ in range(rng.randint(2, 3)))
                known.append((k, h, run, f"P{i}", None, rng.choice(["All", "Morning", "Night"]), p, rng.sample(["Meal", "Work", "Relax"], 2), rng.choice(["valid", "valid", "missing"])))
    patterns = spark.createDataFrame(known, "n_states int, threshold int, run int, pattern_id string, group_id string, band string, sequence string, labels array<string>, status string")
    truth = spark.createDataFrame([(rng.randrange(3), rng.choice(["Meal", "Work"]), s := rng.randrange(0, 700_000), s + rng.randrange(60, 9000)) for _ in range(120)], "home int, category string, a int, b int")
    at = lambda c: F.timestamp_add("SECOND", F.col(c), F.lit(START).cast("timestamp_ntz"))
    return series, patterns, truth.select("home", "category", at("a").alias("start_time"), at("b").alias("end_time"))


@pytest.mark.parametrize("named", [{}, {"other": OTHER, "most_skip": 4000.0}, {"period": ("2024-01-03", "2024-01-06")}])
def test_conditions_and_runs_are_as_each_alone(spark, named):
    series, patterns, truths = inputs(spark)
    got = evaluation.swept_evaluation(series, patterns, truths, ["home"], 0.15, **named)
    assert got["runs"].count() == 4
    for k, h, runs in ((3, 0, (1,)), (5, 1, (2,))):
        for run in runs:
            at = (F.col("n_states") == k) & (F.col("threshold") == h)
            own, s = patterns.filter(at & (F.col("run") == run)).drop("n_states", "threshold", "run"), series.filter(at).drop("n_states", "threshold")
            t = truths
            if "period" in named:
                s, t = (intervals.clip(x, *named["period"]) for x in (s, t))
            found = sequences.occurrences(s, ["home"], own, named.get("other"), named.get("most_skip", 0.0))
            alone = evaluation.interpretation_scores(own, found.withColumn("pattern_id", F.lit(None).cast("string")), t, ["home"], 0.15)
            here = at & (F.col("run") == run)
            assert rows(got["details"].filter(here).drop("n_states", "threshold", "run")) == rows(alone)
            assert rows(got["runs"].filter(here).drop("n_states", "threshold", "run")) == rows(evaluation.summary(alone, []))


def test_hits_count_truths_that_come_twice(spark):
    at = lambda c: F.timestamp_add("SECOND", F.col(c), F.lit(START).cast("timestamp_ntz"))
    spans = lambda x, schema: spark.createDataFrame(x, schema).withColumns({"start_time": at("a"), "end_time": at("b")}).drop("a", "b")
    p = spans([("m", 1, "Meal", 0, 100), ("n", 1, "Work", 0, 50)], "method string, home int, category string, a int, b int")
    t = spans([(1, "Meal", 50, 150), (1, "Meal", 50, 150), (1, "Meal", 160, 200), (2, "Work", 0, 50)], "home int, category string, a int, b int")
    hits = evaluation.processed_hits(p, t, ["home"], 0.0, {}, 0.0, 60.0)[2]
    assert sorted(map(tuple, hits.collect())) == [("m", "Meal", 3, 2, 3), ("m", "Work", 1, 0, 0), ("n", "Meal", 3, 0, 0), ("n", "Work", 1, 0, 0)]


def test_patterns_of_the_sweep_are_read_from_a_table(spark, monkeypatch):
    held = []
    monkeypatch.setattr(evaluations.evaluation, "swept_evaluation", lambda series, patterns, *rest: held.append(patterns))
    evaluations._swept(spark, "/root/testdata/sf0.001")
    plan = held[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and held[0].count() > 0  # nothing is counted again when they are read
