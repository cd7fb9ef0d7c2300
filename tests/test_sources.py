import pytest
from pyspark.sql import functions as F

from lumenlog import sources


def test_event_logs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2024-01-01,00:00:00,Kitchen,ON\n2024-01-01,00:00:02.5,Kitchen,OFF\nbad,x,Kitchen,ON\n")
    rows = sources.binary_events(sources.event_log(spark, str(tmp_path / "a.csv"))).orderBy("source_order").collect()
    assert [(r.sensor, r.bit, r.ts.microsecond) for r in rows] == [("Kitchen", 1, 0), ("Kitchen", 0, 500000)]
    (tmp_path / "b.csv").write_text("2024-01-01 00:00:00,Kitchen,ON\n")
    assert sources.event_log(spark, str(tmp_path / "b.csv")).count() == 1
    assert sources.looks_like_events(spark, str(tmp_path / "a.csv"))


def test_labelled_text(spark, tmp_path):
    (tmp_path / "l.txt").write_text("2024-01-01 00:00:00 M001 ON Meal Preparation begin\n2024-01-01 00:01:00 M001 OFF\n2024-01-01 00:02:00 M001 OFF Meal Preparation end\n")
    rows = sources.labelled_text(spark, str(tmp_path / "l.txt")).orderBy("source_order").collect()
    assert [(r.label, r["mark"]) for r in rows] == [("Meal Preparation", "begin"), (None, None), ("Meal Preparation", "end")]


def test_state_table_and_wide_log(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("状態\tKitchen\tBedroom\n状態1\t0\t1\n状態2\t1\t1\nその他\t-\t-\n")
    rows = sources.state_table(spark, str(tmp_path / "s.tsv")).orderBy("rank").collect()
    assert [(r.state_id, r["mask"]) for r in rows] == [("状態1", 2), ("状態2", 3)]
    (tmp_path / "w.csv").write_text("timestamp,a,b,Activity\n2024-01-01 00:00:00,1,0,x\n")
    assert {(r.sensor, r.bit) for r in sources.wide_log(spark, str(tmp_path / "w.csv")).collect()} == {("a", 1), ("b", 0)}


def test_network_and_patterns(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"nodes": [{"state_id": "S1", "active_sensors": ["a"], "avg_duration_minutes_per_day": 1.5}], "edges": [{"from": "S1", "to": "S2", "probability": 0.5}, {"from": "S1"}]}')
    nodes, edges = sources.network(spark, str(tmp_path / "n.json"))
    assert nodes.count() == 1 and edges.collect() == [("S1", "S2", 0.5)]
    (tmp_path / "p.json").write_text('[{"name": "x", "sequence": ["A", "B"]}, {"name": "y", "sequence": ["C", "D"]}]')
    assert [(r.pattern_id, r.sequence) for r in sources.patterns(spark, str(tmp_path / "p.json")).collect()] == [("P001", "A->B"), ("P002", "C->D")]


def test_model_answers(spark):
    df = spark.createDataFrame([(1, 'Here: ```json\n{"patterns": [{"name": "n", "sequence": ["A", "B"]}]}\n```'), (2, "none"), (3, None)], "id int, answer string")
    assert [tuple(r) for r in sources.pattern_records(df, "answer").collect()] == [(1, 0, "n", "A->B")]


def written_to(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_intervals_and_occurrences_with_other_names(spark, tmp_path):
    path = written_to(tmp_path, "a.csv", "start,end,category,raw_label\n2024-01-01 06:00:00,2024-01-01 07:00:00,wake_up,Bed\n2024-01-01 08:00:00,2024-01-01 09:00:00,nothing known,\n,2024-01-01 09:00:00,Meal,\n")
    got = [(str(r.start_time)[11:16], r.raw_label, r.category) for r in sources.adl_intervals_csv(spark, path).orderBy("start_time").collect()]
    assert got == [("06:00", "Bed", "Wake-up"), ("08:00", "nothing known", "Other")]
    path = written_to(tmp_path, "o.csv", "method,id,sequence,start,end,time_band\nm,P1,a->b,2024-01-01 05:00:00,2024-01-01 06:00:00,\nother,P2,a,2024-01-01 05:00:00,2024-01-01 06:00:00,Night\n,P3,a | b,2024-01-01 19:00:00,2024-01-01 20:00:00,All\n")
    got = [(r.pattern_id, r.sequence, r.band) for r in sources.pattern_occurrences_csv(spark, path, "m").orderBy("pattern_id").collect()]
    assert got == [("P1", "a->b", "Midnight"), ("P3", "a->b", "All")] and sources.pattern_occurrences_csv(spark, path).count() == 3


def test_ordered_series(spark, tmp_path):
    head = "start_time,end_time,state_id\n"
    good = written_to(tmp_path, "s.csv", head + "2024-01-01T00:00:00,2024-01-01T01:00:00,a\n2024-01-01T01:00:00+09:00,2024-01-01T02:00:00+09:00,b\n")
    got = sources.ordered_series(spark, good, "Asia/Tokyo").orderBy("start_time").collect()
    assert [(r.state, (r.end_time - r.start_time).seconds) for r in got] == [("a", 3600), ("b", 3600)] and got[0].end_time == got[1].start_time
    for rows in ("2024-01-01T00:00:00Z,2024-01-01T00:00:00Z,a\n", "2024-01-01T00:00:00Z,2024-01-01T02:00:00Z,a\n2024-01-01T01:00:00Z,2024-01-01T03:00:00Z,b\n", "2024-01-01T00:00:00,2024-01-01T02:00:00,a\n"):
        with pytest.raises(Exception, match="interval"):
            sources.ordered_series(spark, written_to(tmp_path, "bad.csv", head + rows)).collect()


def test_labels_paired_by_key_within_days(spark):
    rows = [("2024-01-01 01:00:00", 1, "begin", "Sleep"), ("2024-01-01 02:00:00", 2, "begin", "Meal"), ("2024-01-01 03:00:00", 3, "end", "Sleep"), ("2024-01-02 04:00:00", 4, "end", "Meal")]
    log = spark.createDataFrame(rows, "ts string, ord int, kind string, raw_label string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(r.raw_label for r in sources.paired_labels(log).collect()) == ["Meal", "Sleep"]
    assert [r.raw_label for r in sources.paired_labels(log, start="2024-01-01", end="2024-01-02").collect()] == ["Sleep"]
    assert sources.first_period(log, 1).count() == 3


def test_interpretations_of_bands(spark, tmp_path):
    text = '[{"pattern_id": "A", "name": "x", "sequence": ["1", "2"], "time_band_interpretations": {"Morning": {"adl_labels": ["Meal", "wake up"]}, "Night": {"adl_labels": ["flying"]}}}, {"name": "y", "sequence": ["2", "3"], "adl_labels": []}]'
    got = {(r.pattern_id, r.sequence, r.band): (r.labels, r.status) for r in sources.band_interpretations(spark, written_to(tmp_path, "p.json", text)).collect()}
    assert got == {("A", "1->2", "Morning"): (["Meal", "Wake-up"], "valid"), ("A", "1->2", "Night"): ([], "unknown"), ("P002", "2->3", "All"): ([], "missing")}


def test_contracts(spark):
    m = {"row_count": 2, "period_start": "a", "period_end": "b", "columns": ["x"], "timezone": "UTC"}
    assert sources.manifest_faults(m, 2, "a", "b", ["x"]) == [] and sources.manifest_faults({**m, "timezone": ""}, 3, "a", "b", ["x"]) == ["row_count", "timezone"]
    events = spark.createDataFrame([("A",), ("B",)], "sensor string")
    assert sources.checked(events, ["A", "B"]).count() == 2
    with pytest.raises(Exception, match="state table"):
        sources.checked(events, ["A"]).collect()
