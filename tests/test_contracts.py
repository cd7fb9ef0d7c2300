"""Snapshots, manifests, readers in order, windows of days, changes inside labels."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenlog import functions as fn
from lumenlog import sources
from lumenlog.operators import intervals, sinks, splits, stats, vectors
from lumenlog.operators.blocks import daily

START = datetime.datetime(2024, 1, 1)
STATED = {"$.schema_version": "1", "$.columns": '["date","time","sensor","value"]', "$.header": "false"}


def snapshot(path, lines, **other):
    folder = path / "2024-01-01_2024-01-03"
    folder.mkdir(parents=True)
    (folder / "events.csv").write_text("".join(f"{x}\n" for x in lines))
    said = {"schema_version": 1, "columns": ["date", "time", "sensor", "value"], "header": False, "timezone": "Asia/Tokyo", "source": {"start": "2024-01-01T00:00:00+09:00", "end_exclusive": "2024-01-02T15:00:00Z"}, "conversion_report": {"output_events": len(lines)}}
    (folder / "manifest.json").write_text(json.dumps(said | other))
    return str(folder)


GOOD = ["2024-01-01,00:00:00,Kitchen,ON", "2024-01-01,00:00:02,Kitchen,off", "2024-01-02,23:59:59,Door,OPEN"]


def test_a_snapshot_without_faults(spark, tmp_path):
    log, faults = sources.snapshot(spark, snapshot(tmp_path, GOOD), STATED)
    assert faults.collect() == []
    assert [(r.sensor, r.value, r.bit) for r in sources.without_faults(log, faults).orderBy("ts").collect()] == [("Kitchen", "ON", 1), ("Kitchen", "OFF", 0), ("Door", "OPEN", 1)]


@pytest.mark.parametrize("lines, other, want", [
    (GOOD + ["2024-01-01,00:00:01,Kitchen"], {}, {"four_columns": 1, "unknown_value": 1, "out_of_order": 1}),
    (GOOD + ["2024-01-02,23:59:59, ,ON"], {}, {"empty_field": 1}),
    (GOOD + ["bad,23:59:59,Door,ON"], {}, {"invalid_time": 1}),
    (GOOD + ["2024-01-03,00:00:00,Door,ON"], {}, {"outside_period": 1}),
    (GOOD + ["2024-01-02,23:59:59,Door,maybe"], {}, {"unknown_value": 1}),
    (GOOD + GOOD[-1:] * 2, {}, {"repeated_row": 2}),
    (GOOD[::-1], {}, {"out_of_order": 2}),
    ([], {}, {"no_rows": 1}),
    (GOOD, {"schema_version": 2, "header": True}, {"manifest $.schema_version": 1, "manifest $.header": 1}),
    (GOOD, {"conversion_report": {"output_events": 4}}, {"manifest $.conversion_report.output_events": 1}),
    (GOOD, {"source": {"start": "2024-01-01T00:00:00", "end_exclusive": "2024-01-03T00:00:00Z"}}, {"manifest $.source.start": 1, "manifest $.source.end_exclusive": 1}),
])
def test_faults_of_a_snapshot(spark, tmp_path, lines, other, want):
    log, faults = sources.snapshot(spark, snapshot(tmp_path, lines, **other), STATED)
    assert {r.rule: r.n for r in faults.collect()} == want
    if set(want) != {"out_of_order"}:
        with pytest.raises(ValueError, match=sorted(set(want) - {"out_of_order"})[0].replace("$", r"\$")):
            sources.without_faults(log, faults)


def test_periods_of_folders():
    assert sources.snapshot_period("/x/2024-01-01_2024-02-01/") == ("2024-01-01", "2024-02-01")
    for name in ("2024-01-01", "a_b", "2024-02-01_2024-01-01", "2024-01-01_2024-01-01"):
        with pytest.raises(ValueError):
            sources.snapshot_period(f"/x/{name}")


@pytest.mark.parametrize("form", ["parquet", "csv", "json"])
def test_what_is_written_is_verified(spark, tmp_path, form):
    path = f"{tmp_path}/t"
    sinks.write_verified(spark.range(40).repartition(3).withColumn("s", F.when(F.col("id") % 3 > 0, F.col("id").cast("string"))), path, form)
    assert sources.verified(spark, path, form).count() == 40
    first = sinks.preparation_fingerprint(spark, [path], {"k": 1})
    assert len(first) == 16 and first == sinks.preparation_fingerprint(spark, [path], {"k": 1}) != sinks.preparation_fingerprint(spark, [path], {"k": 2})
    with pytest.raises(Exception, match="exists"):
        sinks.write_verified(spark.range(1), path, form)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    os.rename(f"{path}/{files[0]}", f"{tmp_path}/kept")
    with pytest.raises(ValueError, match=f"{files[0]} is lost"):
        sources.verified(spark, path, form)
    os.rename(f"{tmp_path}/kept", f"{path}/{files[0]}")
    if form != "parquet":
        data = bytearray(open(f"{path}/{files[1]}", "rb").read())
        data[-2] ^= 1
        for hidden in (f"{path}/.{files[1]}.crc",):
            if os.path.exists(hidden):
                os.remove(hidden)
        open(f"{path}/{files[1]}", "wb").write(bytes(data))
        with pytest.raises(ValueError, match=f"{files[1]} has changed"):
            sources.verified(spark, path, form)
    else:
        spark.range(7).coalesce(1).write.mode("append").parquet(path)
        with pytest.raises(ValueError, match="is new"):
            sources.verified(spark, path, form)


def test_series_of_changes_over_days(spark, tmp_path):
    at = [START + datetime.timedelta(hours=h) for h in (0, 5, 30, 30, 31, 100, 500)]
    rows = list(zip(at, "abcdefg"))
    random.Random(1).shuffle(rows)
    (tmp_path / "s.csv").write_text("timestamp,state\n" + "".join(f"{t},{s}\n" for t, s in rows))
    got = sources.state_series(spark, f"{tmp_path}/s.csv")
    assert sorted((r.start_time, r.end_time) for r in got.collect()) == [(a, b) for a, b in zip(at, at[1:]) if b > a]


def test_order_faults_over_stretches_of_a_file(spark, tmp_path):
    """A file that several tasks read: the fault is between rows of different tasks, or there is none."""
    line = lambda h, s: f"{START + datetime.timedelta(hours=h)},{START + datetime.timedelta(hours=h + 1)},{s}\n".replace(" ", "T")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        (tmp_path / "g.csv").write_text("start_time,end_time,state_id\n" + "".join(line(h, "a") for h in range(400)))
        got = sources.ordered_series(spark, f"{tmp_path}/g.csv", "UTC")
        assert got.count() == 400 and spark.read.csv(f"{tmp_path}/g.csv").rdd.getNumPartitions() > 3
        (tmp_path / "b.csv").write_text("start_time,end_time,state_id\n" + line(390, "a") + "".join(line(h, "a") for h in range(391)))
        with pytest.raises(Exception, match="ordered and apart"):
            sources.ordered_series(spark, f"{tmp_path}/b.csv", "UTC").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def spans(spark, rows, schema):
    at = lambda c: F.timestamp_add("MINUTE", F.col(c), F.lit("2024-01-01").cast("timestamp_ntz"))
    return spark.createDataFrame(rows, schema).withColumns({"start_time": at("a"), "end_time": at("b")})


@pytest.mark.parametrize("of", [lambda: None, daily])
def test_points_strictly_inside(spark, of):
    rng = random.Random(3)
    labels = [(rng.randrange(2), rng.choice("xy"), a := rng.randrange(0, 9000, 60), a + rng.choice([0, 60, 600, 3000])) for _ in range(60)]
    points = [(rng.randrange(2), rng.randrange(0, 9000, 30)) for _ in range(200)]
    p = spark.createDataFrame(points, "home int, m int").withColumn("ts", F.timestamp_add("MINUTE", F.col("m"), F.lit("2024-01-01").cast("timestamp_ntz")))
    got = intervals.strictly_inside(p, spans(spark, labels, "home int, category string, a int, b int"), ["home"], ["home", "category"], of())
    want = {}
    for h, c, a, b in labels:
        if b > a:
            n, k = want.get((h, c), (0, 0))
            want[h, c] = n + 1, k + sum(a < m < b for g, m in points if g == h)
    assert {(r.home, r.category): (r.n_spans, r.n_inside) for r in got.collect()} == want


def test_first_interval_is_no_change(spark):
    series = spans(spark, [(1, 10, 20, 1, "a"), (1, 20, 20, 2, "b"), (1, 20, 40, 3, "Other"), (2, 5, 6, 1, "a")], "home int, a int, b int, ord int, state string")
    labels = spans(spark, [(1, "x", 0, 100), (1, "y", 20, 30), (3, "x", 0, 9)], "home int, category string, a int, b int")
    one, two = intervals.series_metrics(series, labels, ["home"], ["Other"])
    assert {r.home: tuple(r)[1:] for r in one.collect()} == {1: (3, 2, 2, 1, pytest.approx(2 / 3), 2, 2), 2: (1, 0, 1, 0, 0.0, 0, 0)}
    assert {r.category: (r.n_spans, r.n_inside) for r in two.collect()} == {"x": (2, 2), "y": (1, 0)}


def test_occupancy_and_wide(spark):
    rows = spark.createDataFrame([(1, 0, {"a": ["x", "y"], "b": []}), (1, 60, {"b": ["x"]}), (1, 90, {"a": ["x"]})], "home int, m int, who map<string,array<string>>").withColumns({"ts": F.timestamp_add("MINUTE", F.col("m"), F.lit("2024-01-01").cast("timestamp_ntz")), "ord": F.col("m")})
    for block in (None, daily(), F.hour("ts")):
        assert {r.name: (r.hours, r.share) for r in stats.occupancy(rows, ["home"], [], "who", block).collect()} == {"a": (2.0, 0.8), "b": (0.5, 0.2)}
    got = stats.wide(rows, ["home"], "m", [0, 90, 5], F.count(F.lit(1))).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, None)]


def test_windows_of_days(spark):
    rows = spans(spark, [(1, 600, 3000), (1, 3000, 7000), (2, 0, 1500)], "home int, a int, b int")
    windows = lambda x: spark.createDataFrame(x, "role string, first_day int, last_day int")
    good = windows([("learn", 1, 1), ("check", 3, 3), ("test", 4, 9)])
    at = splits.day_windows(rows, ["home"], good)
    day = lambda d, m=0: START + datetime.timedelta(days=d, minutes=m)
    assert {(r.home, r.role): (r.start, r.end) for r in at.filter("home = 1").collect()} == {(1, "learn"): (day(0), day(1)), (1, "check"): (day(2), day(3)), (1, "test"): (day(3), day(0, 7000))}
    cut = splits.in_windows(rows, at, ["home"])
    assert sorted((r.home, r.role, r.start_time, r.end_time) for r in cut.collect()) == [(1, "check", day(2), day(0, 3000)), (1, "check", day(0, 3000), day(3)), (1, "learn", day(0, 600), day(1)), (1, "test", day(3), day(0, 7000)), (2, "learn", day(0), day(1))]
    every = splits.day_windows(rows, ["home"], good, whole=True)
    assert {r.role: (r.start, r.end) for r in every.filter("home = 1").collect()} == {"learn": (day(0), day(1)), "check": (day(0), day(0, 7000)), "test": (day(0), day(0, 7000))}
    for bad, why in (([("a", 0, 1)], "1 or more"), ([("a", 2, 1)], "before it begins"), ([("a", 1, 3), ("b", 3, 4)], "in order and apart")):
        with pytest.raises(Exception, match=why):
            splits.in_windows(rows, splits.day_windows(rows, ["home"], windows(bad)), ["home"]).select("start_time").collect()


def test_state_sequence_and_grids(spark):
    events = spark.createDataFrame([(1, i, s, b) for i, (s, b) in enumerate([("a", 1), ("b", 1), ("b", 1), ("zz", 1), ("a", 0), ("b", 0)])], "home int, ord long, sensor string, bit int").withColumn("ts", F.timestamp_add("MINUTE", F.col("ord"), F.lit("2024-01-01").cast("timestamp_ntz")))
    states = spark.createDataFrame([(1, "S1", 3), (2, "S2", 0)], "rank int, state_id string, mask long")
    seq = lambda **named: [r.state for r in vectors.state_sequence(events, ["home"], ["a", "b"], states, **named).orderBy("ord").collect()]
    assert seq() == [fn.OTHER, "S1", fn.OTHER, "S2"] and seq(compress=False) == [fn.OTHER, "S1", "S1", fn.OTHER, "S2"]
    assert seq(h=1) == seq(h=1, block=daily()) == ["S1", "S2"]
    assert fn.threshold_values(0.0, 1.0, 4) == [0.0, 0.3333, 0.6667, 1.0] and fn.threshold_values(0.2, 1.0, 1) == [0.2]


def test_labels_with_the_same_letters(spark):
    words = ["wake up", "WAKE_UP", "Wake-up", " sleep/", "House work", "nap", "", None]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(fn.normalised_label("w").alias("n")).collect()
    assert [r.n for r in got] == ["Wake-up", "Wake-up", "Wake-up", "Sleep", "Housework", None, None, None]


def test_listed_labels_are_trimmed(spark):
    got = spark.createDataFrame([(" a0 ; 1b ;c ",), ("x 、 y/z",)], "t string").select(fn.label_values("t").alias("v")).collect()
    assert [r.v for r in got] == [["a0", "1b", "c"], ["x", "y/z"]]
