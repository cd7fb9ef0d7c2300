"""Operator 8, n-gram Jaccard join: vertical partitioning.

A document's set holds the hashes of its distinct word n-grams, in their order as numbers: one global order of all n-grams, the same at every size of
the input and known without a pass over it. The order is cut into fragments, which do two things.

* They bring pairs together. Two sets that reach the threshold differ in H n-grams at most, so of more than H fragments that a set has
  n-grams in, one at least is the same in both. A document's keys are the contents of its fragments: rows that share a key have all n-grams of a fragment in common, several of them
  as a rule, so keys meet near copies, not texts that share a common phrase, and there are as many shared keys as there are near copies. H depends on the sizes, so these
  fall into bands (RATIO); a pair meets in the band of the smaller set, and a set near a band's lower end has keys in the band below as well. A set with too few
  fragments that are not empty is cut finer (LEVELS), and where no cut is fine enough, has the n-grams of its prefix as keys.
* They count. A pair's overlap is counted in each of FRAGMENTS wide fragments apart and summed per pair.

Documents with equal sets are one class, held by its first row; only these meet. Sizes (length filter) and parity maps leave pairs out before any
set is read. Rows that share a key meet one of them, as in `near`, so a group of thousands of near copies makes links in proportion to its size,
and no pair that could join two components is left out.

Defined results: words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; fewer words than n are one n-gram; a null text, or one
without words, has an empty set and no links. Rows that repeat a doc_id are documents each; a null doc_id links like any other
and never names a component unless all of it is null. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.chunks import Hasher, lean, pieces_of
from lumenlog.llm.near import ROWS, flagged, mark_of, parity_map, roots_of, wide_maps
from lumenlog.llm.shared import temporary, written

RATIO = 1.5
LEVELS = (1.2, 1.5, 2.0)
MAP_WORDS = 8
FRAGMENTS = 4


_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]
_hasher = Hasher()


def windows(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, from each word on; the last n - 1 have no meaning."""
    x, size = np.full(len(w), n, np.uint64), max(0, len(w) - n + 1)
    for i in range(n):
        x[:size] = (x[:size] ^ w[i : size + i]) * _ODD[i % len(_ODD)]
        x ^= x >> np.uint64(29)
    return x


def shingle_sets(texts: list[str | None] | pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text."""
    for held in pieces_of(texts):
        spans = _hasher(held, lower=True)
        x = windows(spans.key, n)
        for a, b in zip(spans.first[:-1].tolist(), spans.first[1:].tolist()):
            yield np.unique(x[a : b - n + 1]) if b - a >= n else windows(spans.key[a:b], b - a)[:1]


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _band(n: int) -> tuple[int, int]:
    """The least and greatest size in the band that n falls into."""
    low = 1
    while (high := max(low + 1, math.ceil(low * RATIO)) - 1) < n:
        low = high + 1
    return low, high


@functools.lru_cache(1 << 16)
def cuts(n: int, num: int, den: int) -> list[tuple[int, int, list[int]]]:
    """For each band in which a set of n members may meet another: where the band begins, how many members two sets with the smaller one in it may differ in, and
    into how many fragments the order is cut, level by level. A level that would leave sets of the band with too few fragments is none."""
    out, high = [], n
    while high >= -(-num * n // den) and high > 0:
        low, top = _band(high)
        apart = (den - num) * (top + top * den // num) // (den + num)
        fragments = [int(c * apart) + 1 for c in LEVELS]
        if apart:
            out.append((low, apart, [m for m in fragments if m * -math.expm1(-low / m) > apart]))
        high = low - 1
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _ODD[1]
    return x ^ x >> np.uint64(29)


def fragment_keys(x: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of a sorted set."""
    out = [np.empty(0, np.uint64)]
    mixed, high = _mixed(x), x >> np.uint64(32)
    for low, apart, levels in cuts(len(x), num, den):
        for m in levels:
            fragment = high * np.uint64(m) >> np.uint64(32)
            begin = np.flatnonzero(fragment[1:] != fragment[:-1]) + 1
            begin = np.append(0, begin)
            name = _mixed(fragment[begin] + np.uint64((low * 4099 + m) << 20))
            out.append(_mixed(np.add.reduceat(mixed, begin) ^ name))
            if len(begin) > apart:
                break
        else:
            out.append(_mixed(x[: prefix_size(len(x), num, den)] + np.uint64(low)))
    return np.concatenate(out).view(np.int64)


def segment_ends(x: np.ndarray) -> np.ndarray:
    """Where the FRAGMENTS wide fragments of a sorted set end."""
    return np.append(np.searchsorted(x, (np.arange(1, FRAGMENTS) * ((1 << 64) // FRAGMENTS)).astype(np.uint64)), len(x))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def _lists(held: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held), pa.int64()))


def _signatures(held: list[np.ndarray]) -> list[pa.Array]:
    sig = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in held), np.int64).reshape(-1, 2)
    return [pa.array(sig[:, 0]), pa.array(sig[:, 1])]


def document_sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Size, signature, keys and parity map of every row's set, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                held = list(shingle_sets(piece.column("text"), n))
                keys = [fragment_keys(x, num, den) for x in held]
                wide, less = zip(*map(wide_maps, held))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("key"), pa.array(list(map(len, held)), pa.int32()), *_signatures(held), _lists(keys), _lists([parity_map(x, MAP_WORDS) for x in held]), _lists(wide), _lists(less)],
                    names=["doc_id", "key", "n", "sig_a", "sig_b", "grams", "bits", "wide", "less"],
                )

    rows = _keyed(docs).mapInArrow(lean(run), "doc_id long, key long, n int, sig_a long, sig_b long, grams array<long>, bits array<long>, wide array<long>, less array<long>")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "sizes", "uncompressed")


def whole_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """row, segments of the wanted rows (row, doc_id, key, sig_a, sig_b), from their texts; others are left out before anything is computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                held = list(shingle_sets(piece.column("text"), n))
                begin = np.cumsum([0, *map(len, held)])
                ends = np.array([segment_ends(x) for x in held])
                segments = pa.ListArray.from_arrays(pa.array(np.append(0, (ends + begin[:-1, None]).reshape(-1)), pa.int32()), pa.array(np.concatenate(held).view(np.int64)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * FRAGMENTS, pa.int32()), segments)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), *_signatures(held), lists], names=["doc_id", "key", "sig_a", "sig_b", "segments"])

    chosen = flagged(_keyed(docs), ["doc_id", "key"], wanted.select(mark_of("doc_id", "key").alias("mark"))).filter("_hit").drop("_hit")
    found = chosen.mapInArrow(lean(run), "doc_id long, key long, sig_a long, sig_b long, segments array<array<long>>").withColumnRenamed("doc_id", "_id")
    rows = found.join(wanted, ["key", "sig_a", "sig_b"]).filter(F.col("_id").eqNullSafe(F.col("doc_id")))
    return rows.dropDuplicates(["key", "sig_a", "sig_b", "row"]).select("row", "segments")  # dealt by the first three already


def _classed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Every row's doc_id, key (hash of the text) and n, the component's smallest doc_id, and its first document by doc_id and key; written."""
    with temporary(docs.sparkSession):
        return written(_found(docs, n, num, den), "classes", stays=True)


def _found(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    sets = document_sets(docs, n, num, den)
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    # classes of equal sets without their keys and maps, which stay where they are written; only rows that may be no first one of a class are shuffled
    equal = sets.filter("n > 0").groupBy("sig_a", "sig_b", "n").agg(F.min(F.struct("row", "doc_id", "key")).alias("h"), F.min(name).alias("least"))
    equal = written(equal.select("sig_a", "sig_b", "n", "h.*", "least"), "equal")
    again = written(sets.filter("n > 0").select("row").join(equal.select("row"), "row", "left_anti").select(mark_of("row").alias("mark")), "again")
    marked = flagged(sets.filter("n > 0").select("row", "n", "grams", "bits", "wide", "less"), ["row"], again)
    first = marked.filter("_hit").join(equal.select("row"), "row", "left_semi")
    held = marked.filter("NOT _hit").unionByName(first).drop("_hit")

    def sets_of(rows: DataFrame) -> DataFrame:
        wanted = written(equal.select("row", "doc_id", "key", "sig_a", "sig_b").join(rows, "row"), "wanted")
        return whole_sets(docs, n, wanted)

    roots = roots_of(held, sets_of, num, den, MAP_WORDS)
    placed = equal.select("sig_a", "sig_b", "n", "row", "least").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    placed = written(placed, "placed")
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("first")), "root").select("sig_a", "sig_b", "n", "first")
    rows = sets.select("doc_id", "key", "n", "sig_a", "sig_b")
    full = rows.filter("n > 0").join(named, ["sig_a", "sig_b", "n"]).select("doc_id", "key", "n", "first")
    return full.unionAll(rows.filter("n = 0").select("doc_id", "key", "n", name.alias("first")))


def classes(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: links where den * overlap >= num * union; the component's smallest doc_id."""
    return _classed(docs, n, num, den).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row of each component, its first by doc_id and text; rows without words all stay. Columns as they were.

    Only rows whose doc_id and text are dropped, or come again, are shuffled.
    """
    rows = _classed(docs, n, num, den).withColumn("stays", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key") == F.col("first"))
    fate = rows.filter("n > 0").groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times")).filter("NOT stays OR times > 1")
    fate = written(fate, "fate")
    # a row's own columns are one struct here, so none of their names can clash
    whole = docs.select(F.struct("*").alias("whole"), F.xxhash64("text").alias("key"), F.col("doc_id").cast("long").alias("id"))
    keyed = flagged(whole, ["key"], fate.select(mark_of("key").alias("mark")))
    fate = fate.withColumnsRenamed({"doc_id": "fate_id", "key": "fate_key"})
    here = keyed.filter("_hit").join(fate, (F.col("key") == F.col("fate_key")) & F.col("id").eqNullSafe(F.col("fate_id")), "left")
    again = here.filter("stays AND times > 1").groupBy("id", "key").agg(F.any_value("whole").alias("whole"))
    once = here.filter("stays IS NULL OR stays AND times = 1")
    return keyed.filter("NOT _hit").select("whole").unionAll(once.select("whole")).unionAll(again.select("whole")).select("whole.*")
