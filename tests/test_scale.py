"""Operators for very long keys and hot groups give the same rows as their plain forms."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.operators import blocks, percentiles, sequences, stats, vectors

DAY = "2024-01-01"


def series(spark, seed, n=400, homes=3, days=9):
    """Most rows in home 0; gaps of whole days, equal times, null states."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        home, day = (0 if rng.random() < 0.7 else rng.randrange(homes)), rng.choice([d for d in range(days) if d % 4])
        rows.append((home, day * 86_400 + rng.randrange(0, 86_400, 7200), i, rng.choice(["a", "b", "b", "b", None]), rng.choice(["x", "y", "z"]), rng.choice([0, 1, None])))
    start = F.lit(DAY).cast("timestamp_ntz")
    return spark.createDataFrame(rows, "home int, s int, ord long, state string, sensor string, bit int").withColumn("ts", F.timestamp_add("SECOND", F.col("s"), start)).drop("s")


def same(a, b):
    assert a.columns == b.columns
    x, y = (sorted(map(str, df.collect())) for df in (a, b))
    assert x == y and x


@pytest.mark.parametrize("seed, of", [(0, blocks.daily), (1, lambda: blocks.daily(days=3)), (2, lambda: F.hour("ts") * 0)])
def test_series_in_blocks(spark, seed, of):
    s, block = series(spark, seed), of()
    same(sequences.runs(s, ["home"], block), sequences.runs(s, ["home"]))
    same(sequences.steps(s, ["home"], block), sequences.steps(s, ["home"]))
    same(sequences.intervals(s, ["home"], block), sequences.intervals(s, ["home"]))
    same(sequences.durations(s.fillna("n"), ["home"], ["home"], block=block), sequences.durations(s.fillna("n"), ["home"], ["home"]))
    v = vectors.event_vectors(s, ["home"], ["x", "y"])
    same(vectors.event_vectors(s, ["home"], ["x", "y"], block), v)
    same(vectors.compressed(v, ["home"], ("ts", "ord"), block), vectors.compressed(v, ["home"], ("ts", "ord")))


@pytest.mark.parametrize("points", [7, 500])
def test_grids_in_blocks(spark, points):
    s = series(spark, 5)
    a = vectors.sample_and_hold(s, ["home"], ["x", "y", "z"], f"{DAY} 00:00:00", 3600, 200, points)
    same(a, vectors.sample_and_hold(s, ["home"], ["x", "y", "z"], f"{DAY} 00:00:00", 3600, 200))


def test_folds_and_places(spark):
    s = series(spark, 9).withColumn("n", F.col("ord") % 17)
    got = blocks.folded(s, ["home"], blocks.daily(), ("ts", "ord"), {"total": ("sum", F.col("bit")), "most": ("max", F.col("n")), "least": ("min", F.col("n")), "bits": ("bit_or", F.col("n")), "held": ("last", F.col("state"))})
    got = blocks.numbered(got, ["home"], blocks.daily(), ("ts", "ord"))
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (r.home, r.ts, r.ord)):
        x = seen.setdefault(r.home, {"total": None, "most": 0, "least": 99, "bits": 0, "held": None, "place": -1})
        if r.bit is not None:
            x["total"] = (x["total"] or 0) + r.bit
        x |= {"most": max(x["most"], r.n), "least": min(x["least"], r.n), "bits": x["bits"] | r.n, "held": r.state or x["held"], "place": x["place"] + 1}
        assert all(r[k] == v for k, v in x.items())


def test_no_window_holds_a_long_key(spark):
    """Windows by home alone are over summaries of blocks, which an aggregate made; all others have the block in their keys."""
    s = series(spark, 1)
    for df in (sequences.intervals(s, ["home"], blocks.daily()), vectors.event_vectors(s, ["home"], ["x"], blocks.daily())):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        for i, line in enumerate(lines):
            if re.search(r"\bWindow \[", line) and not re.search(r"\], \[home#\d+, _block#", line):
                below = [x for x in lines[i + 1 : i + 6]]
                assert any("Aggregate" in x for x in below), line


def test_empty_and_null_keys(spark):
    s = series(spark, 2)
    assert sequences.runs(s.limit(0), ["home"], blocks.daily()).count() == 0
    lost = s.withColumn("home", F.when(F.col("ord") % 2 == 0, F.col("home")))
    assert sequences.runs(lost, ["home"], blocks.daily()).filter("home IS NULL").count() == 0


def spread(name, rng, n):
    return {"even": lambda: rng.random(n), "heavy": lambda: np.exp(rng.normal(0, 12, n)) * rng.choice([-1, 1], n), "few": lambda: rng.integers(0, 3, n).astype(float), "one": lambda: np.full(n, 7.0), "far": lambda: 1e15 + rng.integers(0, 900, n), "two": lambda: rng.choice([0.0, 1e300], n)}[name]()


@pytest.mark.parametrize("name", ["even", "heavy", "few", "one", "far", "two"])
@pytest.mark.parametrize("most, cells", [(20, 16), (1, 4)])
def test_percentiles_are_exact(spark, monkeypatch, name, most, cells):
    monkeypatch.setattr(percentiles, "CELLS", cells)
    rng = np.random.default_rng(4)
    groups = {"a": spread(name, rng, 700), "b": spread(name, rng, 31), None: spread(name, rng, 2), "one": np.array([3.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("none", None)]
    found = percentiles.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"m": 0.5, "ends": [0.0, 0.9, 1.0]}, most=most)
    got = {r.k: (r.m, *r.ends) for r in found.collect()}
    want = {k: tuple(np.percentile(v, [50, 0, 90, 100])) for k, v in groups.items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_percentiles_of_all_rows_and_of_none(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert [tuple(r) for r in percentiles.percentiles(rows, [], "v", {"q": 0.25}, most=3).collect()] == [(25.0,)]
    assert percentiles.percentiles(rows.limit(0), [], "v", {"q": 0.25}).count() == 0
    assert stats.quantile_distance(rows, rows.withColumn("v", F.col("v") + 3), "v").first()[0] == pytest.approx(3.0)
