"""Readers of event logs, annotations, state tables, pattern files and networks."""

from __future__ import annotations

import datetime
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.functions import OTHER, STATE_HEADING, binary_value, label_sets, normalised_label, parse_sequence, time_band
from lumenlog.operators import blocks
from lumenlog.operators.intervals import pair_annotations
from lumenlog.operators.sinks import file_fingerprints

FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]


def parsed(text: Column) -> Column:
    """A timestamp in one of the formats, without zone; null where none fits."""
    return F.coalesce(F.try_to_timestamp(text).cast("timestamp_ntz"), *(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in FORMATS[3:]))


def numbered(rows: DataFrame) -> DataFrame:
    """File order as a sortable number; it rises inside a file and is no row count."""
    return rows.withColumn("source_order", F.monotonically_increasing_id())


def in_file_order(rows: DataFrame) -> DataFrame:
    """Adds _file, _part (where the stretch that one task reads begins in it) and source_order, which rises inside a stretch."""
    return numbered(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part")))


def event_log(spark: SparkSession, path: str, value: str | None = None) -> DataFrame:
    """Headerless date,time,sensor,value (or timestamp,sensor,value) rows: ts, sensor, value, source_order. Rows without a timestamp or sensor are dropped."""
    raw = numbered(spark.read.schema("a string, b string, c string, d string").csv(path))
    four = F.col("d").isNotNull()
    rows = raw.select(
        parsed(F.when(four, F.concat_ws(" ", F.trim("a"), F.trim("b"))).otherwise(F.trim("a"))).alias("ts"),
        F.trim(F.when(four, F.col("c")).otherwise(F.col("b"))).alias("sensor"),
        F.trim(F.when(four, F.col("d")).otherwise(F.col("c"))).alias("value"),
        "source_order",
    ).filter("ts IS NOT NULL AND sensor IS NOT NULL AND value IS NOT NULL")
    return rows.filter(F.col("value") == value) if value is not None else rows


def binary_events(log: DataFrame, on: list[str] | None = None, off: list[str] | None = None) -> DataFrame:
    """Adds bit; rows whose value is neither on nor off are dropped."""
    kinds = {k: v for k, v in (("on", on), ("off", off)) if v}
    return log.withColumn("bit", binary_value("value", **kinds)).filter(F.col("bit").isNotNull())


def wide_log(spark: SparkSession, path: str, time: str = "timestamp", drop: tuple[str, ...] = ("Activity", "label")) -> DataFrame:
    """One 0/1 column for each sensor, as one row for each time and sensor."""
    raw = numbered(spark.read.option("header", True).csv(path))
    at = time if time in raw.columns else [c for c in raw.columns if c != "source_order"][-1]
    sensors = [c for c in raw.columns if c not in (at, "source_order", *drop)]
    rows = raw.unpivot([at, "source_order"], sensors, "sensor", "value")
    return rows.select(parsed(F.col(at)).alias("ts"), "sensor", F.col("value").try_cast("double").cast("tinyint").alias("bit"), "source_order")


def looks_like_events(spark: SparkSession, path: str) -> bool:
    """Whether the first five lines have three or four fields, the last an on or off value."""
    for line in spark.read.text(path).limit(5).collect():
        parts = [x.strip() for x in line.value.split(",")]
        if len(parts) in (3, 4) and parts[-1].upper() in ("ON", "OFF", "OPEN", "CLOSE", "PRESENT", "ABSENT", "0", "1"):
            return True
    return False


def labelled_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines `date time sensor value [label words begin|end]`: ts, sensor, value, label, mark, source_order."""
    raw = numbered(spark.read.text(path)).withColumn("f", F.split(F.trim("value"), r"\s+")).filter(F.size("f") >= 4)
    last = F.lower(F.element_at("f", -1))
    marked = (F.size("f") >= 6) & last.isin("begin", "end")
    return raw.select(
        parsed(F.concat_ws(" ", F.get("f", F.lit(0)), F.get("f", F.lit(1)))).alias("ts"),
        F.get("f", F.lit(2)).alias("sensor"),
        F.get("f", F.lit(3)).alias("value"),
        F.when(marked, F.array_join(F.expr("slice(f, 5, greatest(size(f) - 5, 0))"), " ")).alias("label"),
        F.when(marked, last).alias("mark"),
        "source_order",
    ).filter("ts IS NOT NULL")


def checked(events: DataFrame, sensors: list[str]) -> DataFrame:
    """The events; one of a sensor that the state table lacks fails the job."""
    known = F.col("sensor").isin(sensors)
    return events.withColumn("sensor", F.when(known, F.col("sensor")).otherwise(F.raise_error(F.concat(F.lit("not in the state table: "), "sensor"))))


def mapped(events: DataFrame, sensor_map: DataFrame) -> DataFrame:
    """Sensors renamed by a small table sensor, name; sensors that it lacks keep their names."""
    return events.join(sensor_map.select("sensor", "name"), "sensor", "left").withColumn("sensor", F.coalesce("name", "sensor")).drop("name")


def sensor_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of sensor ids and names."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("sensor", "name"))
    return text


def state_table(spark: SparkSession, path: str, label: str = STATE_HEADING) -> DataFrame:
    """rank, state_id, mask, sensors of a tab-separated table of 0/1 columns; rows with other marks are skipped."""
    raw = numbered(spark.read.option("header", True).option("sep", "\t").csv(path))
    sensors = [c for c in raw.columns if c not in (label, "source_order")]
    valid = raw.filter(F.forall(F.array(*sensors), lambda x: x.isin("0", "1")))
    mask = sum((F.col(s).cast("long") * F.lit(1 << i) for i, s in enumerate(sensors)), F.lit(0).cast("long"))
    return valid.select(F.row_number().over(Window.orderBy("source_order")).alias("rank"), F.col(label).alias("state_id"), mask.alias("mask"), F.array(*[F.lit(s) for s in sensors]).alias("sensors"))


def state_series(spark: SparkSession, path: str) -> DataFrame:
    """start_time, end_time, state from a CSV of intervals, or of changes (each holds until the next one; the last is dropped)."""
    raw = spark.read.option("header", True).csv(path)
    state = next(c for c in ("state_id", "state", STATE_HEADING) if c in raw.columns)
    if "timestamp" in raw.columns:
        rows = numbered(raw).withColumn("start_time", parsed(F.col("timestamp")))
        # cut by date: a task holds a day, and a row for each day
        rows = blocks.neighbours(rows, [], blocks.daily("start_time"), ("start_time", "source_order"), after={"end_time": F.col("start_time")})
    else:
        a, b = next((x, y) for x, y in (("start_time", "end_time"), ("start", "end")) if x in raw.columns)
        rows = raw.withColumn("_a", parsed(F.col(a))).withColumn("_b", parsed(F.col(b))).select(F.col("_a").alias("start_time"), F.col("_b").alias("end_time"), state)
    return rows.select("start_time", "end_time", F.col(state).alias("state")).filter("end_time > start_time")


def network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a network file; edges without both ends or a chance are skipped."""
    raw = spark.read.schema("nodes array<struct<state_id: string, active_sensors: array<string>, avg_duration_minutes_per_day: double>>, edges array<struct<`from`: string, `to`: string, probability: double>>").json(path, multiLine=True)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*")
    edges = raw.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.probability").alias("prob"))
    return nodes, edges.dropna()


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern_id, pattern_name, sequence (text) of a CSV or JSON file; names of fields vary, sequences may be lists or text."""
    raw = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.json(path, multiLine=True)
    raw = numbered(raw)

    def first(*names: str) -> Column:
        held = [F.col(f"`{n}`") for n in names if n in raw.columns]
        return F.coalesce(*(F.array_join(c, "->") if dict(raw.dtypes)[n].startswith("array") else c.cast("string") for n, c in zip([n for n in names if n in raw.columns], held))) if held else F.lit(None).cast("string")

    seq = F.array_join(parse_sequence(first("sequence", "states", "pattern", "遷移のパターン")), "->")
    nth = F.row_number().over(Window.orderBy("source_order"))
    rows = raw.select(first("pattern_id", "id").alias("_id"), first("pattern_name", "name", "パターン名").alias("pattern_name"), seq.alias("sequence"), nth.alias("_n"))
    return rows.filter("sequence <> ''").select(F.coalesce("_id", F.format_string("P%03d", "_n")).alias("pattern_id"), "pattern_name", "sequence")


def snapshot_faults(log: DataFrame, start: str, end: str) -> DataFrame:
    """One row: how many rows of a snapshot break each rule (time inside the period, known values, no repeated row)."""
    inside = (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    again = log.groupBy("ts", "sensor", "value").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))
    return log.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~inside).alias("outside"), F.count_if(binary_value("value").isNull()).alias("unknown_values")).join(F.broadcast(again))  # one row each


def snapshot_period(path: str) -> tuple[str, str]:
    """First day and the day after the last one, of a folder that is named by both."""
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)_(\d{4}-\d\d-\d\d)", path.rstrip("/").rpartition("/")[2])
    if not m:
        raise ValueError(f"a snapshot's folder is named by its period: {path}")
    start, end = (datetime.date.fromisoformat(x) for x in m.groups())
    if end <= start:
        raise ValueError(f"a snapshot's period has to end after its start: {path}")
    return str(start), str(end)


def snapshot(spark: SparkSession, path: str, stated: dict[str, str], file: str = "events.csv", manifest: str = "manifest.json", zone: str = "$.timezone", period: tuple[str, str] = ("$.source.start", "$.source.end_exclusive"), rows_at: str = "$.conversion_report.output_events") -> tuple[DataFrame, DataFrame]:
    """The log of a snapshot folder (ts, sensor, value, bit, source_order), and its faults: rule, severity (error, warning), n; a rule that is kept has no row.

    Lines have four fields (date, time, sensor, value), none empty, with a time inside the folder's period and a known value, and no line comes twice; a line that is out of order is a warning. The manifest has the
    values of `stated` (JSON paths and texts), a zone, the folder's period as times with offsets that are midnights of that zone, and the number of lines.
    """
    start, end = (F.lit(d).cast("timestamp_ntz") for d in snapshot_period(path))
    fields = F.transform(F.split("value", ",", -1), lambda x: F.trim(x))
    part = lambda i: F.get("_f", F.lit(i))
    raw = in_file_order(spark.read.text(f"{path}/{file}")).withColumn("_f", fields)
    rows = raw.select("_file", "_part", "source_order", F.size("_f").alias("_n"), F.exists("_f", lambda x: x == "").alias("_empty"), parsed(F.concat_ws(" ", part(0), part(1))).alias("ts"), part(2).alias("sensor"), F.upper(part(3)).alias("value")).withColumn("bit", binary_value("value"))
    late = blocks.folded(rows, ["_file"], F.col("_part"), ("source_order",), {"_latest": ("max", F.col("ts"))}, itself=False)
    again = rows.groupBy("ts", "sensor", "value").agg((F.count(F.lit(1)) - 1).alias("_c"))
    n = F.count(F.lit(1))
    counts = {
        "four_columns": F.count_if(F.col("_n") != 4), "empty_field": F.count_if("_empty"), "invalid_time": F.count_if(F.col("ts").isNull()), "unknown_value": F.count_if(F.col("bit").isNull()),
        "outside_period": F.count_if((F.col("ts") < start) | (F.col("ts") >= end)), "no_rows": F.when(n == 0, 1).otherwise(0), "out_of_order": F.count_if(F.col("ts") < F.col("_latest")),
    }
    text = spark.read.text(f"{path}/{manifest}", wholetext=True)
    at = lambda p: F.get_json_object("value", p)
    local = lambda p: F.convert_timezone(F.current_timezone(), at(zone), F.when(F.rlike(at(p), F.lit(r"(Z|[+-]\d\d:?\d\d)$")), F.try_to_timestamp(at(p))).cast("timestamp_ntz"))
    wrong = {f"manifest {p}": at(p) != F.lit(v) for p, v in stated.items()} | {f"manifest {zone}": F.trim(at(zone)) == "", f"manifest {period[0]}": local(period[0]) != start, f"manifest {period[1]}": local(period[1]) != end}
    one = text.agg(*(F.max(F.when(F.coalesce(w, F.lit(True)), 1).otherwise(0)).cast("long").alias(f"_m{i}") for i, w in enumerate(wrong.values())), F.max(at(rows_at)).alias("_rows"))
    sums = late.agg(*(c.cast("long").alias(f"_l{i}") for i, c in enumerate(counts.values())), n.alias("_lines")).join(again.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("_again"))).join(one)  # one row each
    found = [(k, f"_l{i}", "warning" if k == "out_of_order" else "error") for i, k in enumerate(counts)] + [("repeated_row", "_again", "error")] + [(k, f"_m{i}", "error") for i, k in enumerate(wrong)]
    table = [F.struct(F.lit(k).alias("rule"), F.lit(level).alias("severity"), F.coalesce(F.col(c), F.lit(1)).alias("n")) for k, c, level in found]
    table.append(F.struct(F.lit(f"manifest {rows_at}").alias("rule"), F.lit("error").alias("severity"), F.when(F.col("_rows") == F.col("_lines").cast("string"), 0).otherwise(1).cast("long").alias("n")))
    return rows.select("ts", "sensor", "value", "bit", "source_order"), sums.select(F.explode(F.array(*table)).alias("f")).select("f.*").filter("n > 0")


def without_faults(log: DataFrame, faults: DataFrame) -> DataFrame:
    """The log of a snapshot that has no fault but warnings; else an error that names them."""
    if found := faults.filter("severity = 'error'").collect():  # a row a rule
        raise ValueError("; ".join(f"{r.rule}: {r.n}" for r in found))
    return log


def verified(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A table of `sinks.write_verified`; a file that has changed, is lost or came in since is an error that names it."""
    was = spark.read.schema("file string, size long, n_rows long, checksum string").json(f"{path}.manifest")
    now = file_fingerprints(spark, path, form)
    both = was.alias("a").join(now.alias("b"), F.col("a.file") == F.col("b.file"), "full")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.n_rows") == F.col("b.n_rows")) & (F.col("a.checksum") == F.col("b.checksum"))
    if found := both.filter(~F.coalesce(same, F.lit(False))).select(F.coalesce("a.file", "b.file").alias("file"), F.when(F.col("b.file").isNull(), "is lost").when(F.col("a.file").isNull(), "is new").otherwise("has changed").alias("how")).take(5):
        raise ValueError("; ".join(f"{r.file} {r.how}" for r in found))
    reader = spark.read.option("header", True) if form == "csv" else spark.read
    return reader.format(form).load(path)


def represented(events: DataFrame, representation: str, rooms: DataFrame) -> DataFrame:
    """Events by single sensor (`individual`), or with each sensor as its room (`room`; rooms: sensor, name)."""
    if representation not in ("individual", "room"):
        raise ValueError(f"no such representation: {representation}")
    return mapped(events, rooms) if representation == "room" else events


def json_candidates(text: str) -> list:
    """What parses as JSON in a model's answer: the whole text, fenced blocks, balanced pieces; the first that holds records wins."""
    found = [text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)]
    for i, c in enumerate(text):
        if c in "[{":
            try:
                found.append(text[i : i + json.JSONDecoder().raw_decode(text[i:])[1]])
            except ValueError:
                continue
            break
    for piece in found:
        try:
            held = json.loads(piece)
        except ValueError:
            continue
        while isinstance(held, dict) and (inner := next((v for k, v in held.items() if k in ("patterns", "data", "results", "パターン") and isinstance(v, (list, dict))), None)) is not None:
            held = inner
        return held if isinstance(held, list) else [held]
    return []


def pattern_records(answers: DataFrame, column: str) -> DataFrame:
    """name, sequence of each record in model answers (key columns stay); Arrow batches, since the text is not regular JSON."""
    kind = "array<struct<name: string, sequence: string>>"

    @F.pandas_udf(kind)
    def parse(texts):
        out = []
        for t in texts:
            rows = []
            for r in json_candidates(t or ""):
                if isinstance(r, dict):
                    seq = next((r[k] for k in ("sequence", "states", "遷移のパターン", "pattern") if r.get(k)), None)
                    parts = [str(x).strip() for x in seq] if isinstance(seq, list) else re.split(r"\s*(?:->|→|\||,)\s*", seq.strip()) if isinstance(seq, str) else []
                    if parts:
                        rows.append({"name": next((str(r[k]) for k in ("name", "pattern_name", "パターン名") if r.get(k)), None), "sequence": "->".join(parts)})
            out.append(rows)
        import pandas as pd

        return pd.Series(out)

    keys = [c for c in answers.columns if c != column]
    return answers.select(*keys, F.posexplode(parse(column)).alias("pos", "r")).select(*keys, "pos", "r.*")


def is_other(state: Column | str) -> Column:
    return (F.col(state) if isinstance(state, str) else state) == OTHER


def _first(raw: DataFrame, *names: str) -> Column:
    """The first of these columns that a row has a value in; columns that a file lacks are passed over."""
    held = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in raw.columns]
    return F.coalesce(*held) if held else F.lit(None).cast("string")


def adl_intervals_csv(spark: SparkSession, path: str) -> DataFrame:
    """start_time, end_time, raw_label, category of a CSV whose columns have one of several names; labels that are not known are `Other`, rows without a time or label are left out."""
    raw = spark.read.option("header", True).csv(path)
    label = _first(raw, "adl_category", "category", "raw_label")
    rows = raw.select(parsed(_first(raw, "start_time", "start")).alias("start_time"), parsed(_first(raw, "end_time", "end")).alias("end_time"), F.coalesce(_first(raw, "raw_label"), label).alias("raw_label"), label.alias("_l"))
    return rows.dropna(subset=["start_time", "end_time", "_l"]).select("start_time", "end_time", "raw_label", F.coalesce(normalised_label("_l"), F.lit("Other")).alias("category"))


def pattern_occurrences_csv(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    """pattern_id, pattern_name, sequence, start_time, end_time, band of a CSV of occurrences; with `method`, rows of other methods are left out. The band is that of the start where the file has none."""
    raw = spark.read.option("header", True).csv(path)
    start = parsed(_first(raw, "start_time", "start"))
    rows = raw.select(
        _first(raw, "method").alias("_m"), _first(raw, "pattern_id", "id").alias("pattern_id"), F.coalesce(_first(raw, "pattern_name"), F.lit("")).alias("pattern_name"),
        F.array_join(parse_sequence(F.coalesce(_first(raw, "sequence"), F.lit(""))), "->").alias("sequence"), start.alias("start_time"), parsed(_first(raw, "end_time", "end")).alias("end_time"), F.coalesce(_first(raw, "time_band"), time_band(start)).alias("band"),
    ).dropna(subset=["pattern_id", "start_time", "end_time"])
    return (rows if method is None else rows.filter(F.col("_m").isNull() | (F.col("_m") == method))).drop("_m")


def ordered_series(spark: SparkSession, path: str, zone: str | None = None) -> DataFrame:
    """start_time, end_time (UTC instants), state of a CSV of ISO times; times without an offset are in `zone`. A time that is none, an interval that ends at or before its start, or one that
    begins before the one before it in the file ends fails the job. Each stretch of a file is looked at by itself, with the latest end of those before it."""
    raw = in_file_order(spark.read.option("header", True).csv(path))

    def instant(name: str) -> Column:
        offset = F.rlike(F.trim(name), F.lit(r"(Z|[+-]\d\d:?\d\d)$"))
        local = F.to_utc_timestamp(F.try_to_timestamp(F.concat(F.trim(name), F.lit("Z"))), zone) if zone else F.lit(None).cast("timestamp")
        return F.when(offset, F.try_to_timestamp(F.trim(name))).otherwise(local)

    rows = raw.select("_file", "_part", "source_order", F.col("state_id").alias("state"), instant("start_time").alias("start_time"), instant("end_time").alias("end_time"))
    rows = blocks.folded(rows, ["_file"], F.col("_part"), ("source_order",), {"_before": ("max", F.col("end_time"))}, itself=False)  # a file is one home's series
    before = F.col("_before")
    fault = F.when(F.col("start_time").isNull() | F.col("end_time").isNull() | (F.col("end_time") <= F.col("start_time")), "invalid state interval").when(before > F.col("start_time"), "state intervals must be ordered and apart")
    return rows.withColumn("state", F.when(fault.isNull(), F.col("state")).otherwise(F.raise_error(fault))).select("start_time", "end_time", "state")


def paired_labels(log: DataFrame, key: str = "raw_label", start: str | None = None, end: str | None = None) -> DataFrame:
    """Intervals of begin and end marks of a labelled log by raw label or by category, of days from `start` to before `end`; no rule for what follows a sleep.

    log: ts, ord, kind (begin, end) and the key. Marks of one key may nest; the latest open one ends first.
    """
    rows = log
    if start is not None:
        rows = rows.filter(F.to_date("ts") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.to_date("ts") < F.lit(end).cast("date"))
    return pair_annotations(rows, [key])


def first_period(log: DataFrame, days: int) -> DataFrame:
    """Rows of a log less than `days` times 24 hours after its first row."""
    first = log.agg(F.min("ts").alias("_t0"))
    return log.join(F.broadcast(first), F.col("ts") < F.timestamp_add("DAY", F.lit(days), F.col("_t0"))).drop("_t0")  # one row


def stated_events(log: DataFrame) -> DataFrame:
    """Rows whose value is one of those that mean on or off."""
    return log.filter(binary_value("value").isNotNull())


def band_interpretations(spark: SparkSession, path: str) -> DataFrame:
    """pattern_id, pattern_name, sequence, band, labels (array), status of a JSON list of patterns: one row for each band that `time_band_interpretations` has, else one for `All`."""
    text = numbered(spark.read.text(path, wholetext=True))
    kind = "array<struct<pattern_id: string, id: string, pattern_name: string, name: string, sequence: array<string>, adl_labels: array<string>, time_band_interpretations: map<string, struct<adl_labels: array<string>>>>>"
    rows = text.select(F.posexplode(F.from_json("value", kind)).alias("n", "p")).select("n", "p.*")
    own = F.create_map(F.lit("All"), F.struct(F.col("adl_labels")))
    bands = F.when(F.size(F.coalesce("time_band_interpretations", F.create_map().cast("map<string, struct<adl_labels: array<string>>>"))) > 0, F.col("time_band_interpretations")).otherwise(own)
    each = rows.withColumn("_id", F.coalesce("pattern_id", "id", F.format_string("P%03d", F.col("n") + 1))).select("_id", F.coalesce("pattern_name", "name").alias("pattern_name"), "sequence", F.explode(bands).alias("band", "_l"))
    sets = label_sets(F.col("_l.adl_labels"))
    return each.select(F.col("_id").alias("pattern_id"), "pattern_name", F.array_join("sequence", "->").alias("sequence"), "band", sets["labels"].alias("labels"), sets["status"].alias("status"))


def manifest_faults(manifest: dict, n_rows: int, start: str, end: str, columns: list[str]) -> list[str]:
    """What a snapshot's manifest says that its log does not keep: number of rows, period, columns, zone."""
    said = {"row_count": n_rows, "period_start": start, "period_end": end, "columns": columns}
    return [k for k, v in said.items() if manifest.get(k) != v] + ([] if manifest.get("timezone") else ["timezone"])
