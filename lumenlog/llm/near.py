"""Components of rows whose sets are alike, from entries that bring likely pairs together.

An entry says that a row may be met under a key (the content of a fragment of its set, a MinHash band). Rows under one key meet one of them, not each
other: first the one that shares most of its keys, then, where a key's rows are still in several components, another one of the
largest. After that, only rows outside the component that holds most of a key's rows are compared with the key's rows in other
components, and a map of bits of each row decides in the join which of these pairs can be links at all. So all links that could join two components are looked at, and a
key with very many alike rows costs as many comparisons as it has rows. Tables of one row a key are written before they are joined, so that
both sides of these joins are plain shuffles, which Spark splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.chunks import lean
from lumenlog.llm.components import components
from lumenlog.llm.shared import temporary, written

#: Places of the largest maps, as bits: 8 MB and 32 MB. Where more is marked than fits, more passes by chance, up to all; the joins behind maps decide in any case.
MARK_BITS = 26
KEY_BITS = 28
HUB_TURNS = 2
#: Rows of a batch that a task works on at a time.
ROWS = 1024


def map_bits(n: int, most: int, each: int) -> int:
    """The bits of a place in a map of n marks with `each` places for one, so that few others pass by chance: a map's size follows what it marks."""
    return max(12, min(most, (max(1, each * n) - 1).bit_length()))


def mark_of(*columns: str) -> Column:
    """A row's hash, whose last bits are its place in a map."""
    return F.xxhash64(*columns)


def flagged(rows: DataFrame, columns: list[str], places: DataFrame) -> DataFrame:
    """rows with `_hit`: whether the row's place in a map is one of those in `places` (a written table's column `mark`, see `mark_of`).

    The map has sixteen places for each mark, 2**MARK_BITS at most, and is broadcast as words of 64; it is there to keep most other rows out of a
    shuffle. Some pass by chance, and the join behind it is what decides.
    """
    mask = F.lit((1 << map_bits(places.count(), MARK_BITS, 16)) - 1).cast("long")
    words = places.select(F.col("mark").bitwiseAND(mask).alias("mark")).groupBy(F.expr("CAST(mark div 64 AS INT)").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(mark % 64 AS INT))")).alias("_bits"))
    placed = rows.withColumn("_mark", mark_of(*columns).bitwiseAND(mask)).withColumn("_word", F.expr("CAST(_mark div 64 AS INT)"))
    hit = F.coalesce(F.expr("getbit(_bits, CAST(_mark % 64 AS INT)) = 1"), F.lit(False))
    return placed.join(F.broadcast(words), "_word", "left").withColumn("_hit", hit).drop("_word", "_bits", "_mark")


class KeyMap:
    """The first bits of some hashes (a written table's column) as a map of bits that goes to all tasks: 32 places for each, 2**KEY_BITS at most."""

    def __init__(self, hashes: DataFrame, column: str):
        self.bits = map_bits(hashes.count(), KEY_BITS, 32)
        place = F.shiftrightunsigned(column, 64 - self.bits)
        table = hashes.select(place.alias("p")).groupBy(F.expr("CAST(p div 64 AS INT)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits")).toArrow()
        self.words = np.zeros(max(1, 1 << self.bits >> 6), np.uint64)
        self.words[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.int64).view(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each of these (unsigned) may be one of them."""
        at = hashes >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def linked(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """Of the pairs (a, b, n_a, n_b; written), those with den * overlap >= num * union, by `segments` of their sets: overlaps by fragment, summed per pair."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    sets = written(sets_of(pairs.select(F.col("a").alias("row")).unionAll(pairs.select("b")).distinct()), "sets", "uncompressed")

    def side(name: str) -> DataFrame:
        rows = flagged(sets, ["row"], pairs.select(mark_of(name).alias("mark"))).filter("_hit")
        return rows.select(F.col("row").alias(name), F.posexplode("segments").alias("fragment", f"held_{name}")).filter(F.size(f"held_{name}") > 0)

    partial = pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("held_a", "held_b")).alias("both"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("both").alias("both"))
    return summed.filter(F.expr(f"{den}L * both >= {num}L * (n_a + n_b - both)")).select("a", "b")


def _bits_allow(x: str, y: str, words: int, num: int, den: int) -> Column:
    """Whether `bits` leave a pair: a bit tells whether an odd number of a set's members fall to it, so sets whose maps differ in d bits differ
    in d members at least, and a link allows for the sum of sizes less twice the least overlap only. No link is lost."""
    apart = " + ".join(f"bit_count({x}.bits[{i}] ^ {y}.bits[{i}])" for i in range(words))
    return F.expr(f"{apart} <= {x}.n + {y}.n - 2 * ceil({num}L * ({x}.n + {y}.n) / {num + den}L - 1e-9)")


def parity_map(members: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits of a set of hashes."""
    size = 64 * words
    return np.packbits((np.bincount((members & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def map_words(n: int) -> int:
    """Words of a wide map: two bits a member at least."""
    words = 8
    while 32 * words < n:
        words *= 4
    return words


def wide_maps(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A parity map as wide as the set asks for, and the next narrower one (none below the narrowest), to be held against sets of either width."""
    words = map_words(len(members))
    return parity_map(members, words), parity_map(members, words // 4) if words > 8 else np.empty(0, np.int64)


def _wide_allow(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that wide maps leave, as in `_bits_allow`; pairs whose widths are further apart than one step stay."""
    for name in ("a", "b"):
        pairs = pairs.join(held.select(F.col("row").alias(name), F.struct("wide", "less").alias(f"m_{name}")), name)
    x, y = F.size("m_a.wide"), F.size("m_b.wide")
    p = F.when(x == y, F.col("m_a.wide")).when(x == 4 * y, F.col("m_a.less")).when(4 * x == y, F.col("m_a.wide"))
    q = F.when(x == y, F.col("m_b.wide")).when(x == 4 * y, F.col("m_b.wide")).when(4 * x == y, F.col("m_b.less"))
    apart = F.aggregate(F.zip_with(p, q, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda sum_, i: sum_ + i)
    most = F.expr(f"n_a + n_b - 2 * ceil({num}L * (n_a + n_b) / {num + den}L - 1e-9)")
    return pairs.filter(F.coalesce(apart <= most, F.lit(True))).select("a", "b", "n_a", "n_b")


def shared_entries(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """row, n, gram of the keys in `grams` that two rows hold, and of a few others; and the keys (gram) that two rows hold. Both written.

    The keys are counted; those that come twice are marked in a map, and only what it lets through
    goes on, which for keys that are mostly unique is a small part.
    """
    twice = written(held.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram"), "twice")
    sent = held.sparkSession.sparkContext.broadcast(KeyMap(twice, "gram"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                lists = piece.column("grams")
                n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                grams = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                keep = np.flatnonzero(sent.value.holds(grams.view(np.uint64)))
                owner = pa.array(np.repeat(np.arange(len(n)), n)[keep])
                yield pa.RecordBatch.from_arrays([piece.column("row").take(owner), piece.column("n").take(owner), pa.array(grams[keep])], names=["row", "n", "gram"])

    return written(held.select("row", "n", "grams").mapInArrow(lean(run), "row long, n int, gram long"), "marked"), twice


def _pairs(joined: DataFrame) -> DataFrame:
    """a, b, n_a, n_b of joined rows x and y, the smaller row first, each pair once."""
    ordered = F.expr("x.row < y.row")
    return joined.select(
        F.least("x.row", "y.row").alias("a"),
        F.greatest("x.row", "y.row").alias("b"),
        F.when(ordered, F.col("x.n")).otherwise(F.col("y.n")).alias("n_a"),
        F.when(ordered, F.col("y.n")).otherwise(F.col("x.n")).alias("n_b"),
    ).distinct()


def roots_of(held: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, words: int) -> DataFrame:
    """node, root of the rows that have links.

    held: row, n (size of the row's set), grams (its keys), bits (its parity map, of so many words), and where sets are large, wide and less (see `wide_maps`).
    sets_of: row, segments of the rows of a table.
    """
    with temporary(held.sparkSession):
        return written(_roots_of(held, sets_of, num, den, words), "roots", stays=True)


def _roots_of(held: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, words: int) -> DataFrame:
    entries, twice = shared_entries(held)
    entries = written(entries.join(twice, "gram"), "entries")
    maps = held.select("row", "bits")
    allowed = F.expr(f"least(x.n, y.n) * {den}L >= greatest(x.n, y.n) * {num}L")  # by length

    # rows that share most of their keys come first: the text that others were copied from
    central = entries.groupBy("row").agg(F.count(F.lit(1)).alias("c"))
    known = written(entries.join(central, "row").withColumn("root", F.col("row")), "known")
    open_, links, tried = known, None, None

    def fresh(pairs: DataFrame) -> DataFrame:
        """Those that no turn has looked at, written: no pair of sets is compared twice."""
        pairs = _wide_allow(pairs, held, num, den) if "wide" in held.columns else pairs
        return written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")

    for turn in range(HUB_TURNS):
        order = F.xxhash64("row", F.lit(turn)) if turn else F.struct((-F.col("c")).alias("c"), "row")
        main = open_.filter("root = main") if turn else open_
        hubs = written(main.groupBy("gram").agg(F.min_by(F.struct("row", "n", "root"), order).alias("h")).select("gram", "h.*"), "hubs")
        star = open_.alias("x").join(hubs.alias("y"), "gram").filter("x.root <> y.root").filter(allowed)
        pairs = _with_maps(_pairs(star), maps).filter(_bits_allow("x", "y", words, num, den)).select("a", "b", "n_a", "n_b")
        pairs = fresh(pairs)
        with temporary(held.sparkSession):  # the sets are the bulk
            more = linked(pairs, sets_of, num, den)
            links = written(more if links is None else links.unionAll(more), "links", stays=True)
        tried = pairs.select("a", "b") if tried is None else tried.unionAll(pairs.select("a", "b"))
        found = components(links)
        roots = written(found.withColumnsRenamed({"node": "row", "root": "_root"}), "roots")
        known = written(known.join(roots, "row", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root"), "known")
        open_ = written(_open(known), "open")
        if open_.isEmpty():
            return found

    open_ = written(open_.join(maps, "row"), "compared")
    rest = open_.filter("root <> main").alias("x").join(open_.alias("y"), "gram")
    rest = rest.filter(F.expr("x.root <> y.root AND (y.root = y.main OR x.row < y.row)") & allowed & _bits_allow("x", "y", words, num, den))
    return components(links.unionAll(linked(fresh(_pairs(rest)), sets_of, num, den)))


def _open(known: DataFrame) -> DataFrame:
    """Entries of keys whose rows are in several components, with the one that most are in."""
    of_key = known.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("c"))
    split = of_key.groupBy("gram").agg(F.max(F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    return known.join(written(split.select("gram", F.col("most.root").alias("main")), "split"), "gram")


def _with_maps(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    x = maps.select(F.col("row").alias("a"), F.col("bits").alias("bits_a"))
    y = maps.select(F.col("row").alias("b"), F.col("bits").alias("bits_b"))
    both = pairs.join(x, "a").join(y, "b")
    return both.withColumn("x", F.struct(F.col("n_a").alias("n"), F.col("bits_a").alias("bits"))).withColumn("y", F.struct(F.col("n_b").alias("n"), F.col("bits_b").alias("bits")))
