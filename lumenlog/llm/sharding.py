"""Operator 7, sharding: sampled splitters [native].

Rows are put in the order (hash of the text, hash of the doc_id), so equal texts stand side by side and a hot text can
still be cut between its rows. The hashes are the first HASH_BITS bits of md5. A sample in which a row's chance follows its weight gives splitters at equal
quantiles; a range that holds too much weight all the same is sampled again and subdivided. A splitter begins at a text's first row,
but where INSIDE or more fall on one text it is cut by the second hash. Inside a range a window numbers
the rows and sums their weights; what stands before a range comes from one number a range. So no task holds more
than a range, and the shard of a row follows from its exact place in the whole order:

* law `bytes`: the middle of the row's bytes on the line of all bytes, so shards differ by less than two rows' sizes; where all rows of a text together weigh
  less than TOGETHER of a shard, the middle of them all, so such a text is not split between shards and these differ by 2 * TOGETHER more;
* law `rows`: the row's number, so counts differ by one at most.

A row finds its range in two small tables of splitters, by the leading bits of its hashes: they have one entry for each splitter, and 2**CELL_BITS rows or 2**SUB_BITS
for each hot text, so they are broadcast.

Defined results: a null text is an empty one (size 16, crc32 0); rows that repeat a doc_id or text are all kept;
a null doc_id is an id like others; an empty table gives an empty table; other columns are ignored. Nothing depends on how rows lie in files.
"""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.llm.shared import temporary, written

RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 20
OVERFULL = 4
ROUNDS = 3
TOGETHER = 0.005
INSIDE = 4
HASH_BITS = 60
CELL_BITS = 12
SUB_BITS = 4
Splitter = tuple[int, int | None]


def _in_order(s: Splitter) -> tuple:
    return s[0], s[1] is not None, s[1] or 0


def _splitters(sample: list[tuple[int, int]], step: int) -> set[Splitter]:
    """Every step-th of a sorted sample: a text's first row where one falls on it, else places inside it."""
    out: set[Splitter] = set()
    for key, own in groupby(sample[step - 1 :: step], lambda s: s[0]):
        subs = [sub for _, sub in own]
        out.update([(key, None)] if len(subs) < INSIDE else [(key, sub) for sub in subs])
    return out


def _table(spark: SparkSession, rows: list[tuple], **kinds: str) -> DataFrame:
    """A small table from a literal, so that no Python worker makes its rows."""
    text = json.dumps([dict(zip(kinds, r)) for r in rows])
    kind = ", ".join(f"{n}: {k}" for n, k in kinds.items())
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def _ranged(rows: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """Adds `range`, the number of splitters at or before a row."""
    spark = rows.sparkSession
    by_key = [(key, [sub for _, sub in own]) for key, own in groupby(splitters, lambda s: s[0])]
    by_cell: dict[int, list] = {}
    for key, subs in by_key:
        by_cell.setdefault(key >> (HASH_BITS - CELL_BITS), []).append((key, len(subs), subs != [None]))
    cells, base = [], 0
    for cell in range(1 << CELL_BITS):
        own = by_cell.get(cell, [])
        cells.append((cell, base, [{"key": key, "n": n, "inside": cut} for key, n, cut in own]))
        base += sum(n for _, n, _ in own)
    inside = []
    for key, subs in by_key:
        if subs == [None]:
            continue
        held = [s for s in subs if s is not None]
        whole = len(subs) - len(held)
        for cell in range(1 << SUB_BITS):
            low = cell << (HASH_BITS - SUB_BITS)
            inside.append((key, cell, whole + sum(s < low for s in held), [s for s in held if s >> (HASH_BITS - SUB_BITS) == cell]))
    found = rows.withColumn("cell", F.shiftright("key", HASH_BITS - CELL_BITS)).join(F.broadcast(_table(spark, cells, cell="long", base="long", held="array<struct<key: long, n: int, inside: boolean>>")), "cell")
    at = F.expr("base + aggregate(filter(held, s -> s.key < key OR s.key = key AND NOT s.inside), 0L, (sum, s) -> sum + s.n)")
    found = found.withColumn("range", at).drop("cell", "base", "held")
    if inside:
        table = _table(spark, inside, key="long", cell="long", base="long", subs="array<long>")
        found = found.withColumn("cell", F.shiftright("sub", HASH_BITS - SUB_BITS)).join(F.broadcast(table), ["key", "cell"], "left")
        found = found.withColumn("range", F.col("range") + F.expr("coalesce(base + size(filter(subs, s -> s <= sub)), 0)")).drop("cell", "base", "subs")
    return found


def _hash(text) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def shard(docs: DataFrame, shards: int = 40, law: str = "bytes") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; see the module's text."""
    if law not in ("bytes", "rows") or shards < 1:
        raise ValueError("law is bytes or rows, and there is a shard at least")
    with temporary(docs.sparkSession):
        placed = _placed(docs, shards, law)
    firsts = placed.groupBy("shard").agg(F.min("number").alias("first"))  # a row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("number") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _placed(docs: DataFrame, shards: int, law: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and number in the whole order of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _hash(text).alias("key"),
        _hash(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))).alias("sub"),
    )
    rows = written(rows.withColumn("weight", F.col("size") if law == "bytes" else F.lit(1).cast("long")), "keys")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = max(1, total // (shards * RANGES_PER_SHARD))

    def sample(of: DataFrame) -> list[tuple[int, int]]:
        """A row's chance is SAMPLES_PER_RANGE for each `share` of weight: about as many rows as that, whatever the size of the table."""
        drawn = F.shiftrightunsigned(F.xxhash64("key", "sub", F.lit(7)), 11) * F.lit(2.0**-53)
        return sorted(map(tuple, of.filter(drawn < F.col("weight") * F.lit(SAMPLES_PER_RANGE / share)).select("key", "sub").collect()))

    splitters = sorted(_splitters(sample(rows), SAMPLES_PER_RANGE), key=_in_order) if n else []
    for left in range(ROUNDS, -1, -1):
        ranged = _ranged(rows, splitters)
        totals = ranged.groupBy("range").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows")).collect()  # as many as splitters
        overfull = [r["range"] for r in totals if r["weight"] > OVERFULL * share and r["rows"] > 1]
        more = _splitters(sample(ranged.filter(F.col("range").isin(overfull))), SAMPLES_PER_RANGE // 2) - set(splitters) if overfull and left else None
        if not more:
            break
        splitters = sorted({*splitters, *more}, key=_in_order)
    before, weight_before, rows_before = [], 0, 0
    for r in sorted(totals, key=lambda r: r["range"]):
        before.append((r["range"], weight_before, rows_before))
        weight_before, rows_before = weight_before + r["weight"], rows_before + r["rows"]

    order = Window.partitionBy("range").orderBy("key", "sub")
    of_text = Window.partitionBy("range", "key")
    placed = ranged.join(F.broadcast(_table(docs.sparkSession, before, range="long", weight_before="long", rows_before="long")), "range")
    placed = placed.withColumns(
        {"before": F.col("weight_before") + F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight"), "number": F.col("rows_before") + F.row_number().over(order) - 1}
    )
    if law == "bytes":
        placed = placed.withColumns({"text_weight": F.sum("weight").over(of_text), "text_before": F.min("before").over(of_text)})
        light = F.col("text_weight") <= int(TOGETHER * total / shards)
        middle = F.when(light, 2 * F.col("text_before") + F.col("text_weight")).otherwise(2 * F.col("before") + F.col("weight"))
        placed = placed.withColumn("middle", middle)
    at = f"middle * {shards} div {2 * max(1, total)}" if law == "bytes" else f"number * {shards} div {max(1, n)}"
    placed = placed.select("doc_id", "size", "text_crc32", "number", F.least(F.expr(at), F.lit(shards - 1)).cast("int").alias("shard"))
    return written(placed, "placed", stays=True)
