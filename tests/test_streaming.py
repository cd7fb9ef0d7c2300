from datetime import datetime

from lumenlog import streaming


def test_windows_and_sessions_over_a_stream(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, m), m % 2) for m in (0, 10, 50)] + [(1, datetime(2024, 1, 1, 3, 0), 1), (2, datetime(2024, 1, 1, 0, 5), 1)]
    spark.createDataFrame(rows, "home int, ts timestamp, bit int").write.parquet(str(tmp_path / "in"))
    for name, build in (("windows", streaming.window_counts), ("sessions", streaming.sessions)):
        stream = spark.readStream.schema("home int, ts timestamp, bit int").parquet(str(tmp_path / "in"))
        q = build(stream, ["home"]).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    windows = {(r.home, r.start.hour): (r.n, r.n_on) for r in spark.table("windows").collect()}
    assert windows[1, 0] == (3, 0) and windows[2, 0] == (1, 1)
    assert sorted(r.n for r in spark.table("sessions").filter("home = 1").collect())[:2] == [1, 2]
