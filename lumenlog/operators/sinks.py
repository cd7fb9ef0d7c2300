"""Writers: tables, networks, state tables, and hashes of what was written."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.functions import OTHER, STATE_HEADING, seconds_between


def write_csv(rows: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """Columns in a fixed order with a header; an existing folder is refused. `single`: one file, for small reports."""
    out = rows.select(*columns)
    (out.coalesce(1) if single else out).write.mode("errorifexists").option("header", True).csv(path)


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in tables.items():
        write_csv(rows, f"{path}/{name}", rows.columns)


def network_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row `json`: nodes in order of rank, edges in the order they were seen first, chances with three decimals. Both hold at most states squared rows."""
    n = nodes.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "state_id", "active_sensors", "avg_duration_minutes_per_day"))), lambda x: F.struct(x["state_id"].alias("state_id"), x["active_sensors"].alias("active_sensors"), F.round(x["avg_duration_minutes_per_day"], 3).alias("avg_duration_minutes_per_day"))).alias("nodes"))
    e = edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "src", "dst", "prob"))), lambda x: F.struct(x["src"].alias("from"), x["dst"].alias("to"), F.round(x["prob"], 3).alias("probability"))).alias("edges"))
    return n.join(F.broadcast(e)).select(F.to_json(F.struct("nodes", "edges")).alias("json"))  # one row each


def active_sensors(mask: str, sensors: list[str]):
    """Names of the bits that are set, in the order of places."""
    return F.filter(F.array(*[F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, F.lit(s)) for i, s in enumerate(sensors)]), lambda x: x.isNotNull())


def minutes_per_day(held: DataFrame, by: list[str], days: int) -> DataFrame:
    """Average minutes a day in each state of intervals, three decimals."""
    return held.groupBy(*by, "state").agg(F.round(F.sum(seconds_between("start_time", "end_time")) / F.lit(days * 60.0), 3).alias("avg_duration_minutes_per_day"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows and a checksum that depends on neither their order nor their partitions."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def snapshots(events: DataFrame, keys: list[str], sensors: list[str]) -> DataFrame:
    """The latest state of each sensor after each event as a JSON object, where it changes; sensors without an event yet are left out.

    One running value a sensor, so a row holds no history.
    """
    order = Window.partitionBy(*keys).orderBy("ts", "ord")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    state = F.to_json(F.struct(*(F.last(F.when(F.col("sensor") == s, F.col("bit").cast("int")), ignorenulls=True).over(upto).alias(s) for s in sorted(sensors))))
    return events.withColumn("snapshot", state).withColumn("_p", F.lag("snapshot").over(order)).filter(~F.col("snapshot").eqNullSafe(F.col("_p"))).drop("_p")


def state_table_tsv(states: DataFrame, sensors: list[str], path: str, label: str = STATE_HEADING, other: str = OTHER) -> None:
    """States (rank, state_id, mask) as a tab-separated table with a column of 0 and 1 for each sensor, and a row of dashes for what is not mapped."""
    rows = states.select("rank", F.col("state_id").alias(label), *(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, "1").otherwise("0").alias(s) for i, s in enumerate(sensors)))
    last = states.sparkSession.range(1).select(F.lit(1 << 30).alias("rank"), F.lit(other).alias(label), *(F.lit("-").alias(s) for s in sensors))
    rows.unionByName(last).coalesce(1).sortWithinPartitions("rank").drop("rank").write.mode("errorifexists").option("header", True).option("sep", "\t").csv(path)  # k rows


def sequences_json(counts: DataFrame, path: str, order: list, most: int | None = None) -> None:
    """Rows of sequences with their counts or chances as JSON lines in one file, in order; `most`: the first so many."""
    ranked = counts.orderBy(*order)
    (ranked.limit(most) if most is not None else ranked).coalesce(1).write.mode("errorifexists").json(path)


def file_fingerprints(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """file, size, n_rows, checksum of each file of a table: a sum of hashes of its rows (of its lines, in text formats), so that one task holds neither a file nor its rows, and files are spread."""
    rows = spark.read.parquet(path) if form == "parquet" else spark.read.text(path)
    content = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}) if form == "parquet" else F.col("value")
    h = F.conv(F.substring(F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    named = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"), h.alias("_h"))
    return named.groupBy("file", "size").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_h").cast("string").alias("checksum"))


def write_verified(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes a table and, beside it in path.manifest, the fingerprint of each of its files; an existing table is refused. Read it with `sources.verified`."""
    out = rows.write.mode("errorifexists").format(form)
    (out.option("header", True) if form == "csv" else out).save(path)
    file_fingerprints(rows.sparkSession, path, form).coalesce(1).write.mode("errorifexists").json(f"{path}.manifest")  # a row a file


def preparation_fingerprint(spark: SparkSession, paths: list[str], parameters: dict) -> str:
    """Sixteen hex digits that stand for the parameters and for every file of the tables at these paths, by their manifests."""
    kept = "file string, size long, n_rows long, checksum string"
    sums = [tuple(fingerprint(spark.read.schema(kept).json(f"{p}.manifest"), ["file", "size", "n_rows", "checksum"]).first()) for p in paths]
    return hashlib.sha256(json.dumps([parameters, sums], ensure_ascii=False, sort_keys=True).encode("utf-8")).hexdigest()[:16]
