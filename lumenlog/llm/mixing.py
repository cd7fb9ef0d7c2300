"""Operator 9, mixing sources to target weights: Pfair scheduling.

A source's documents, in a seeded random order, form blocks of BLOCK documents. The weights become whole numbers, whose sum is the number of slots of a
frame, so they hold exactly; a float is read as the simplest fraction that it stands for, so 1 / 3 is a third. Only weights whose sum would pass MOST_SLOTS are rounded to that
many slots, which adds half a block to the deviation after MOST_SLOTS blocks. Of a source of weight w, block i may go out from slot floor(i / w) on and has to be out before slot ceil((i + 1) / w). Going through the slots, the
block with the earliest deadline among those that may go out is next, which keeps each source's blocks within less than one of
weight * slots at every slot. The schedule of a frame repeats, so the slot of any block is arithmetic, not a
simulation over all blocks. When a source runs dry the others share its weight: a new phase with its own frame; there are as many
phases as sources at most.

Documents are numbered inside a source without putting a source into one task: a first table counts the documents of each
(source, bucket of the random order), and windows number them inside the buckets, of about BUCKET rows each. Until then a row's own columns are one struct, so their names can't clash.

Defined results: a null source is a source; null texts and repeated rows are documents like others; sources without a target
weight share what the others leave in equal parts, or have the mean weight where nothing is left; weights of zero or less and more than MOST_SOURCES sources are
refused. An empty table gives an empty table. `phase`, `slot` and `offset` say where a document
goes; other columns stay, but one with such a name is replaced. Rows with equal doc_id and text may change places with each other.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.shared import written

BLOCK = 100
BUCKET = 2_000
MOST_SLOTS = 100_000
MOST_SOURCES = 1000
BROADCAST_BYTES = 64 << 20


def fraction(w) -> Fraction:
    """A weight as it was meant: the simplest fraction that gives the float."""
    near = Fraction(w).limit_denominator(1_000_000)
    return near if float(near) == float(w) else Fraction(str(w))


def whole(weights: dict, most: int = MOST_SLOTS) -> dict:
    """The weights as whole numbers: exactly in proportion where their sum stays within `most`, else by largest remainders of `most`."""
    exact = {s: fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    out = {s: int(w * scale) for s, w in exact.items()}
    shared = math.gcd(*out.values())
    out = {s: w // shared for s, w in out.items()}
    if sum(out.values()) <= most:
        return out
    total = sum(exact.values())
    parts = {s: w * most / total for s, w in exact.items()}
    out = {s: max(1, int(x)) for s, x in parts.items()}
    for s in sorted(parts, key=lambda s: (int(parts[s]) - parts[s], s))[: max(0, most - sum(out.values()))]:
        out[s] += 1
    return out


def schedule(slots_of: dict) -> list:
    """The source of each slot of a frame: earliest deadline first among released blocks, in whole numbers."""
    frame = sum(slots_of.values())
    waiting = [(0, i, s) for i, s in enumerate(slots_of)]  # release, tie, source; a source's next block only
    heapq.heapify(waiting)
    sent, ready, out = dict.fromkeys(slots_of, 0), [], []
    for slot in range(frame):
        while waiting and waiting[0][0] <= slot:
            _, i, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(sent[s] + 1) * frame // slots_of[s]), i, s))
        _, i, s = heapq.heappop(ready)
        out.append(s)
        sent[s] += 1
        if sent[s] < slots_of[s]:
            heapq.heappush(waiting, (sent[s] * frame // slots_of[s], i, s))
    return out


def phases(blocks: dict, weights: dict) -> list[dict]:
    """Until all blocks are out: the sources that still have some, their frame, where the phase begins, and what was out before."""
    left, done, begin, out = {s: b for s, b in blocks.items() if b}, dict.fromkeys(blocks, 0), 0, []
    while left:
        slots_of = whole({s: weights[s] for s in left})
        order = schedule(slots_of)
        size = len(order)
        places: dict = {s: [] for s in left}
        for slot, s in enumerate(order):
            places[s].append(slot)
        # the first slot that would want a block that its source does not have ends the phase
        end = min(left[s] // slots_of[s] * size + places[s][left[s] % slots_of[s]] for s in left)
        out.append({"begin": begin, "size": size, "places": places, "before": {s: done[s] for s in left}})
        for s in list(left):
            sent = end // size * slots_of[s] + sum(p < end % size for p in places[s])
            left[s], done[s] = left[s] - sent, done[s] + sent
            if not left[s]:
                del left[s]
        begin += end
    return out


def placed(docs: DataFrame, weights: dict | None, block: int, seed: int, source: str) -> DataFrame:
    """whole (a row's own columns), phase, slot, offset."""
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("source")
    keyed = docs.select(F.struct("*").alias("whole"), name, F.xxhash64("doc_id", "text", F.lit(seed)).alias("order"), F.col("doc_id").alias("id"))
    counts = dict(keyed.groupBy("source").agg(F.count(F.lit(1))).limit(MOST_SOURCES + 1).collect())
    if not counts:
        return keyed.select("whole", F.lit(0).alias("phase"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("offset"))
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: mix groups of them")
    given = {"null" if s is None else f"={s}": fraction(w) for s, w in (weights or {}).items()}
    if any(not w > 0 for w in given.values()):
        raise ValueError("weights are above zero")
    held = {s: given[s] for s in counts if s in given}
    rest, total = len(counts) - len(held), sum(held.values())
    share = (1 - total if 0 < total < 1 else total / len(held) * rest if held else Fraction(rest)) / max(1, rest)
    targets = {s: held.get(s, share) for s in sorted(counts)}
    blocks = {s: -(-counts[s] // block) for s in targets}

    plan = phases(blocks, targets)
    bits = max(0, (max(counts.values()) // BUCKET).bit_length())
    keyed = keyed.withColumn("bucket", F.shiftrightunsigned("order", 64 - bits) if bits else F.lit(0).cast("long"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "buckets")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "id")
    numbered = keyed.withColumn("inside", F.row_number().over(inside) - 1).join(sizes, ["source", "bucket"]).withColumn("number", F.col("first") + F.col("inside"))
    numbered = numbered.withColumn("block", F.expr(f"number div {block}"))

    steps = [(s, i, p["before"][s], p["begin"], p["size"], len(places), places) for i, p in enumerate(plan) for s, places in p["places"].items()]
    table = spark.createDataFrame(steps, "source string, phase int, since long, begin long, size long, own long, places array<long>")
    ends = Window.partitionBy("source").orderBy("since", "phase")
    table = table.withColumn("until", F.coalesce(F.lead("since").over(ends), F.lit((1 << 63) - 1)))
    if 8 * sum(p["size"] for p in plan) <= BROADCAST_BYTES:  # a number for each slot of each phase's frame
        table = F.broadcast(table)
    out = numbered.join(table, "source").filter("block >= since AND block < until")
    slot = F.expr("begin + (block - since) div own * size + get(places, CAST((block - since) % own AS INT))")
    return out.select("whole", "phase", slot.alias("slot"), F.expr(f"number % {block}").alias("offset"))


def mixed(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, seed: int = 7, source: str = "source") -> DataFrame:
    """All rows with phase, slot and offset: the order (slot, offset) holds each source's target weight. Without weights all sources weigh the same."""
    own = [F.col("whole").getField(c).alias(c) for c in docs.columns if c not in ("phase", "slot", "offset")]
    return placed(docs, weights, block, seed, source).select(*own, "phase", "slot", "offset")


def in_order(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, seed: int = 7, source: str = "source") -> DataFrame:
    """The rows, columns as they were, in the order of the mix: ranges of slots, sorted."""
    return placed(docs, weights, block, seed, source).orderBy("slot", "offset").select("whole.*")


def places(stored: DataFrame) -> DataFrame:
    """The rows of a table that `in_order` has been written to, with `place`: the row's number in the order of the mix, gapless from 0.

    A file's name tells which range of the order it has, and a row's index where in the file it stands, so nothing is sorted again: what comes to the driver is a
    count for each file. A table that is not read from parquet files has no such order.
    """
    named = stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = stored.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("n")).collect()
    ends = list(accumulate((r.n for r in sorted(counts, key=lambda r: r._file)), initial=0))
    first = stored.sparkSession.createDataFrame([(r._file, at) for r, at in zip(sorted(counts, key=lambda r: r._file), ends)], "_file string, _first long")
    return named.join(F.broadcast(first), "_file").select(*stored.columns, (F.col("_first") + F.col("_row")).alias("place"))
