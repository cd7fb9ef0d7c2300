"""The tables as event logs: a user is a home, an event type a sensor and a state, a value of 35 or more is on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions import OTHER, time_band

SENSORS = ["click", "error", "purchase", "signup", "view"]
SPLIT = "2024-01-22"
# The vocabulary of activity labels.
LABELS = ["Bathing", "Eating", "Enter_Home", "Housekeeping", "Leave_Home", "Meal_Preparation", "Relax", "Sleeping", "Wake_Up", "Work"]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """home, ts, ord, sensor, bit, state, band, date."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").alias("home"),
        "ts",
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("sensor"),
        (F.col("value") >= 35).cast("int").alias("bit"),
        F.when(F.col("event_type") == "error", F.lit(OTHER)).otherwise(F.col("event_type")).alias("state"),
        time_band("ts").alias("band"),
        F.to_date("ts").alias("date"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def label_of(k):
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.pmod(k, F.lit(10)).cast("int") + 1)


def truths(events: DataFrame) -> DataFrame:
    """home, category, start_time, end_time: signups hold for their value in minutes."""
    us = F.round(F.col("value") * 60.0).cast("long") * 1_000_000
    rows = events.filter("sensor = 'signup'").select("home", label_of(F.col("k")).alias("category"), F.col("ts").alias("start_time"), F.timestamp_add("MICROSECOND", us, F.col("ts")).alias("end_time"), "ord")
    return rows.filter("end_time > start_time")


def predictions(events: DataFrame) -> DataFrame:
    """home, category, start_time, end_time: views hold for two thirds of their value in minutes."""
    us = F.round(F.col("value") * 40.0).cast("long") * 1_000_000
    rows = events.filter("sensor = 'view'").select("home", label_of(F.col("k")).alias("category"), F.col("ts").alias("start_time"), F.timestamp_add("MICROSECOND", us, F.col("ts")).alias("end_time"), "ord")
    return rows.filter("end_time > start_time")


_LIST = ", ".join(f"'{x}'" for x in LABELS)

#: The same in DuckDB: common tables that every oracle query may use.
EV = f"""ev AS (
  SELECT user_id AS home, ts, event_id AS ord, event_type AS sensor, CAST(value >= 35 AS INTEGER) AS bit,
    CASE WHEN event_type = 'error' THEN '{OTHER}' ELSE event_type END AS state,
    CASE WHEN hour(ts) < 6 THEN 'Midnight' WHEN hour(ts) < 10 THEN 'Morning' WHEN hour(ts) < 18 THEN 'Daytime' ELSE 'Night' END AS band,
    CAST(ts AS DATE) AS date, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
)"""
INTERVAL_TABLES = f"""{EV}, tr AS (
  SELECT home, ([{_LIST}])[k % 10 + 1] AS category, ts AS start_time, ts + to_microseconds(CAST(round(value * 60.0) AS BIGINT) * 1000000) AS end_time, ord
  FROM ev WHERE sensor = 'signup' AND round(value * 60.0) > 0
), pr AS (
  SELECT home, ([{_LIST}])[k % 10 + 1] AS category, ts AS start_time, ts + to_microseconds(CAST(round(value * 40.0) AS BIGINT) * 1000000) AS end_time, ord
  FROM ev WHERE sensor = 'view' AND round(value * 40.0) > 0
)"""


def runs_sql(keys: str, name: str = "r", source: str = "ev") -> str:
    """Compressed runs per key as table `name`."""
    return f"{name} AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY {keys} ORDER BY ts, ord) AS _p FROM {source}) WHERE _p IS NULL OR _p <> state)"
