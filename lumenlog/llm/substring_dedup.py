"""Operator 6, substring dedup: paragraph MinHash banding.

A document's paragraphs (the pieces between line feeds) of at least MIN_WORDS words are compared by the sets of their n-word shingles. The bands are
tuned for recall: `tuned` takes the fewest bands of MIN_ROWS minima that bring a pair at the threshold together with at least RECALL. Paragraphs that
collide in a band are verified by exact Jaccard similarity, and the components of what passes are the groups of removals: the first place (by
doc_id, then text, then paragraph) keeps its passage, the others lose it.

Paragraphs with the same words are one class before any banding, and a class meets others as in `near`, so neither a passage that a third of all rows share
nor a large group of near copies makes pairs in the square of its size.

A passage that is part of a longer line or runs over line ends is found by `runs`, in what the paragraphs' removal leaves: every stretch of RUN words
or more that stands in two places, exactly, wherever it begins. Of the hashes of SEED words in a row, the least among those in RUN words stands
for these; equal stretches have equal ones, so only stretches whose least hash comes twice are compared, by the signature of all their words. The first
place of each stretch of RUN words keeps it, the others lose it, and stretches one word apart with the same first place are one run. So a run's span is the exact
common one, and no run is missed but by chance of a hash. In a text that repeats itself without a gap, words of the first place stay. Stretches that are
only nearly alike and lie inside longer lines are found where RUN words on end are equal.

Defined results: words as in operator 8 (ASCII letters lower-cased, ASCII white space). Null and empty texts stay as they are, and so do shorter
paragraphs where no run reaches into them.
Rows with the same doc_id and the same text are one document, so they keep or lose a passage together. A null doc_id comes first. An empty
table gives an empty table; other columns are kept by `cleaned`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.chunks import Hasher, lean, pieces_of
from lumenlog.llm.jaccard_join import _ODD, windows
from lumenlog.llm.near import KeyMap, flagged, mark_of, parity_map, roots_of
from lumenlog.llm.shared import temporary, written

MIN_WORDS = 20
MIN_ROWS = 3
RECALL = 0.999
MAP_WORDS = 2
RUN = 50
SEED = 25
_WORD = re.compile(rb"[^\t\n\v\f\r ]+")
_hasher = Hasher()


def tuned(threshold: float, rows: int = MIN_ROWS, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows: a pair at the threshold collides in some band with at least `recall`."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))), rows


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20_240))
    a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    return a << np.uint64(1) | np.uint64(1), b


class Paragraphs:
    """The paragraphs of some texts that take part: owner (the text's place), number, words, signature, and sorted distinct shingles."""

    def __init__(self, held: list[bytes], n: int, min_words: int):
        spans = _hasher(held, lower=True)
        feeds = np.cumsum(np.frombuffer(spans.data, np.uint8) == 10)
        doc = np.repeat(np.arange(len(held)), np.diff(spans.first))
        at = np.cumsum([0, *(len(t) + 1 for t in held)])[:-1]
        line = feeds[spans.start] if len(spans.start) else np.empty(0, np.int64)
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(line)))
        kept = count >= min_words
        self.size = int(kept.sum())
        if not self.size:
            return
        first = begin[kept]
        self.owner = doc[first]
        self.para = line[first] - (feeds[at] - (np.frombuffer(spans.data, np.uint8)[at] == 10))[self.owner]
        self.n_words = count[kept]
        w = spans.key[np.repeat(kept, count)]
        ends = np.cumsum(self.n_words)
        self.sig = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w[e - k : e]) for e, k in zip(ends.tolist(), self.n_words.tolist())), np.int64).reshape(-1, 2)
        x = windows(w, n)
        keep = np.ones(len(w), bool)
        for i in range(1, n):
            keep[ends - i] = False  # windows that reach into the next paragraph
        x, owner = x[keep], np.repeat(np.arange(self.size), self.n_words - (n - 1))
        order = np.argsort(x, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
        x = x[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
        self.x, owner = x[new], owner[new]
        self.starts = np.searchsorted(owner, np.arange(self.size))
        self.n = np.diff(np.append(self.starts, len(self.x))).astype(np.int32)

    def bands(self, bands: int, rows: int) -> np.ndarray:
        mul, add = _seeds(bands * rows)
        out = np.empty((self.size, bands), np.int64)
        for b in range(bands):
            h = np.full(self.size, b, np.uint64)
            for r in range(rows):
                y = self.x * mul[b * rows + r] + add[b * rows + r]
                h = (h ^ np.minimum.reduceat(y ^ y >> np.uint64(31), self.starts)) * _ODD[r % len(_ODD)]
                h ^= h >> np.uint64(29)
            out[:, b] = h.view(np.int64)
        return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def _pieces(batches: Iterator[pa.RecordBatch], n: int, min_words: int) -> Iterator[tuple[list[pa.Array], Paragraphs]]:
    for batch in batches:
        at = 0
        for texts in pieces_of(batch.column("text")):
            piece, at = batch.slice(at, len(texts)), at + len(texts)
            held = Paragraphs(texts, n, min_words)
            if held.size:
                owner = pa.array(held.owner)
                yield [piece.column("doc_id").take(owner), piece.column("key").take(owner), pa.array(held.para, pa.int32()), pa.array(held.sig[:, 0]), pa.array(held.sig[:, 1])], held


def paragraph_bands(docs: DataFrame, n: int, bands: int, rows: int, min_words: int) -> DataFrame:
    """One row for each paragraph that takes part: its place, the hash of its words, the size of its set and the hashes of its bands; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, held in _pieces(batches, n, min_words):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(held.size + 1) * bands, pa.int32()), pa.array(held.bands(bands, rows).reshape(-1)))
            bits = np.concatenate([parity_map(x, MAP_WORDS) for x in np.split(held.x, held.starts[1:])])
            maps = pa.ListArray.from_arrays(pa.array(np.arange(held.size + 1) * MAP_WORDS, pa.int32()), pa.array(bits))
            yield pa.RecordBatch.from_arrays([*place, pa.array(held.n_words.astype(np.int32)), pa.array(held.n), lists, maps], names=["doc_id", "key", "para", "sig_a", "sig_b", "n_words", "n", "grams", "bits"])

    found = _keyed(docs).mapInArrow(lean(run), "doc_id long, key long, para int, sig_a long, sig_b long, n_words int, n int, grams array<long>, bits array<long>")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "paragraphs", "uncompressed")


def paragraph_sets(docs: DataFrame, n: int, min_words: int, wanted: DataFrame) -> DataFrame:
    """row, segments (one) of the wanted paragraphs (row, doc_id, key, para, sig_a, sig_b), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, held in _pieces(batches, n, min_words):
            sets = pa.ListArray.from_arrays(pa.array(np.append(held.starts, len(held.x)), pa.int32()), pa.array(held.x.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*place, pa.ListArray.from_arrays(pa.array(np.arange(held.size + 1), pa.int32()), sets)], names=["doc_id", "key", "para", "sig_a", "sig_b", "segments"])

    chosen = flagged(_keyed(docs), ["doc_id", "key"], wanted.select(mark_of("doc_id", "key").alias("mark"))).filter("_hit").drop("_hit")
    found = chosen.mapInArrow(lean(run), "doc_id long, key long, para int, sig_a long, sig_b long, segments array<array<long>>")
    found = flagged(found, ["key", "para"], wanted.select(mark_of("key", "para").alias("mark"))).filter("_hit").drop("_hit").withColumnRenamed("doc_id", "_id")
    rows = found.join(wanted, ["key", "para", "sig_a", "sig_b"]).filter(F.col("_id").eqNullSafe(F.col("doc_id")))
    return rows.dropDuplicates(["key", "para", "sig_a", "sig_b", "row"]).select("row", "segments")  # dealt by the first four already


def repeated(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, min_words: int = MIN_WORDS) -> DataFrame:
    """The places of all passages that stand in two places or more.

    doc_id, key (hash of the text), para, n_words, first_doc_id and first_para (the place that is kept), removed.
    """
    bands, rows = tuned(num / den)
    min_words = max(min_words, n)
    paras = paragraph_bands(docs, n, bands, rows, min_words)
    place = F.struct("doc_id", "key", "para")
    equal = paras.groupBy("sig_a", "sig_b").agg(F.min(F.struct("row", "n", "doc_id", "key", "para")).alias("h"), F.min(place).alias("low"), F.max(place).alias("high"), F.any_value("grams").alias("grams"), F.any_value("bits").alias("bits"))
    equal = written(equal.select("sig_a", "sig_b", "h.*", "low", "high", "grams", "bits"), "equal", "uncompressed")

    def sets_of(these: DataFrame) -> DataFrame:
        wanted = written(equal.select("row", "doc_id", "key", "para", "sig_a", "sig_b").join(these, "row"), "wanted")
        return paragraph_sets(docs, n, min_words, wanted)

    roots = roots_of(equal.select("row", "n", "grams", "bits"), sets_of, num, den, MAP_WORDS)
    placed = equal.select("sig_a", "sig_b", "row", "low", "high").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    placed = written(placed, "placed")
    groups = placed.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("root", "low")
    named = placed.select("sig_a", "sig_b", "root").join(groups, "root").select("sig_a", "sig_b", "low")
    places = paras.select("doc_id", "key", "para", "n_words", "sig_a", "sig_b").join(named, ["sig_a", "sig_b"])
    return places.select("doc_id", "key", "para", "n_words", F.col("low.doc_id").alias("first_doc_id"), F.col("low.para").alias("first_para"), (F.struct("doc_id", "key", "para") != F.col("low")).alias("removed")).distinct()


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


def _stretched(w: np.ndarray, n: int, odd: list[np.uint64]) -> np.ndarray:
    """Hashes of n words in a row by doubling, from each word on; the last n - 1 have no meaning."""

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = x * odd[0] ^ (y ^ y >> np.uint64(31)) * odd[1]
        z = (z ^ z >> np.uint64(29)) * odd[2]
        return z ^ z >> np.uint64(32)

    x, size, out, at = w, 1, None, 0
    while True:
        if n & 1:
            out, at = x if out is None else joined(out, _shifted(x, at)), at + size
        n >>= 1
        if not n:
            return out
        x, size = joined(x, _shifted(x, size)), 2 * size


def _sliding(x: np.ndarray, n: int, of: Callable) -> np.ndarray:
    """The least or greatest of n values in a row, from each on; the last n - 1 have no meaning."""
    size = 1
    while 2 * size <= n:
        x, size = of(x, _shifted(x, size)), 2 * size
    return of(x, _shifted(x, n - size)) if size < n else x


class Stretches:
    """The stretches of RUN words of some texts: owner (the text's place), first word, and the least hash of SEED words in them."""

    def __init__(self, held: list[bytes]):
        self.spans = spans = _hasher(held, lower=True)
        n = np.diff(spans.first)
        self.doc = np.repeat(np.arange(len(held)), n)
        self.at = np.arange(len(self.doc))
        self.whole = self.at + RUN <= np.repeat(spans.first[1:], n)
        self.seeds = _stretched(spans.key, SEED, _ODD)
        self.least = np.where(self.whole, _sliding(self.seeds, RUN - SEED + 1, np.minimum), np.uint64(0))

    @staticmethod
    def mixed(seeds: np.ndarray) -> np.ndarray:
        """Least values are small ones; these are spread again."""
        x = seeds * _ODD[3]
        x = (x ^ x >> np.uint64(32)) * _ODD[4]
        return x ^ x >> np.uint64(29)

    def chosen(self) -> np.ndarray:
        """The words where a hash begins that is the least of some stretch; a text's last RUN - 1 words begin none, so texts don't mix."""
        k = RUN - SEED
        most = _sliding(np.concatenate([np.zeros(k, np.uint64), self.least]), k + 1, np.maximum)[: len(self.least)]
        return np.flatnonzero((self.seeds == most) & (most > 0))

    def signatures(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (_stretched(self.spans.key, RUN, odd)[at].view(np.int64) for odd in (_ODD[1:], [_ODD[4], *_ODD[:2]]))
        return a, b


def _seeds_twice(left: DataFrame) -> KeyMap:
    """A map of the least hashes that stand in two places or more, and of some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in pieces_of(batch.column("text")):
                piece, done = batch.slice(done, len(texts)), done + len(texts)
                held = Stretches(texts)
                at = held.chosen()
                if len(at):
                    word = (at - held.spans.first[held.doc[at]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(held.mixed(held.seeds[at]).view(np.int64)), piece.column("place").take(pa.array(held.doc[at])), pa.array(word)], names=["seed", "place", "word"])

    found = left.select("text", F.xxhash64("doc_id", "key").alias("place")).mapInArrow(lean(run), "seed long, place long, word int")
    place = F.struct("place", "word")
    twice = found.groupBy("seed").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high")
    return KeyMap(written(twice.select("seed"), "seeds"), "seed")


def _line_before(line: int, gone: list[int] | None) -> int:
    """The number that a line had before lines were taken out."""
    for g in sorted(gone or ()):
        if g > line:
            break
        line += 1
    return line


def stretches(left: DataFrame) -> DataFrame:
    """doc_id, key, word, para, sig_a, sig_b of the stretches of RUN words that may stand in two places or more; written."""
    sent = left.sparkSession.sparkContext.broadcast(_seeds_twice(left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in pieces_of(batch.column("text")):
                piece, done = batch.slice(done, len(texts)), done + len(texts)
                held = Stretches(texts)
                at = np.flatnonzero(held.whole & sent.value.holds(held.mixed(held.least)))
                if not len(at):
                    continue
                x = np.frombuffer(held.spans.data, np.uint8)
                feeds = np.cumsum(x == 10)
                begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
                owner = held.doc[at]
                line = feeds[held.spans.start[at]] - (feeds[begin] - (x[begin] == 10))[owner]
                gone = piece.column("_gone")
                for i in np.unique(owner).tolist():
                    if some := gone[i].as_py():
                        of, back = np.unique(line[owner == i], return_inverse=True)
                        line[owner == i] = np.array([_line_before(int(n), some) for n in of])[back]
                a, b = held.signatures(at)
                own = pa.array(owner)
                word = (at - held.spans.first[owner]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(own), piece.column("key").take(own), pa.array(word), pa.array(line.astype(np.int32)), pa.array(a), pa.array(b)], names=["doc_id", "key", "word", "para", "sig_a", "sig_b"])

    return written(left.select("doc_id", "key", "text", "_gone").mapInArrow(lean(run), "doc_id long, key long, word int, para int, sig_a long, sig_b long"), "stretches")


def runs(left: DataFrame) -> DataFrame:
    """The places of all runs of RUN words or more that stand in two places or more of texts (doc_id, key, text, _gone: the lines that were taken out).

    doc_id, key, para (where it begins), start and n_words (counted in the text), first_doc_id and first_para (the place that is kept), removed.
    """
    held = stretches(left)
    place = F.struct("doc_id", "key", "word")
    firsts = held.groupBy("sig_a", "sig_b").agg(F.min(F.struct("doc_id", "key", "word", "para")).alias("low"), F.min(place).alias("at"), F.max(place).alias("high")).filter("at <> high").select("sig_a", "sig_b", "low")
    firsts = written(firsts, "firsts")  # so that the join may split a stretch that very many texts share
    # dealt by document once, which serves the distinct rows, the windows and the groups below
    met = held.join(firsts, ["sig_a", "sig_b"]).select("doc_id", "key", "word", "para", "low").repartition("doc_id", "key").distinct()
    met = met.withColumns({"_apart": F.col("word") - F.col("low.word"), "_own": F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("key") == F.col("low.key"))})
    line = Window.partitionBy("doc_id", "key", "low.doc_id", "low.key", "_apart").orderBy("word")
    met = met.withColumn("_run", F.col("word") - F.row_number().over(line))
    found = met.groupBy("doc_id", "key", F.col("low.doc_id").alias("first_doc_id"), F.col("low.key").alias("_first_key"), "_apart", "_own", "_run").agg(
        F.min(F.struct("word", "para", F.col("low.para").alias("first_para"))).alias("b"), F.max("word").alias("last")
    )
    kept = F.when(F.col("_own") & F.col("_apart").between(1, RUN - 1), RUN - F.col("_apart")).otherwise(0)  # words of the first place itself
    start = F.col("b.word") + kept
    return found.select("doc_id", "key", F.col("b.para").alias("para"), start.alias("start"), (F.col("last") + RUN - start).alias("n_words"), "first_doc_id", F.col("b.first_para").alias("first_para"), (~F.col("_own") | (F.col("_apart") != 0)).alias("removed"))


def _without_lines(text: str, gone: str) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(F.col(gone), i))
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))


def _gone(places: DataFrame, stays: bool = False) -> DataFrame:
    gone = places.filter("removed").groupBy("doc_id", "key").agg(F.collect_set("para").alias("_gone"))
    return written(gone.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), "gone", stays=stays)


def _left(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, key (of the whole text), text without the lines that are gone, and their numbers. Only documents that lose something are shuffled."""
    keyed = flagged(_keyed(docs), ["key"], gone.select(mark_of("_key").alias("mark")))
    here = keyed.filter("_hit").join(gone, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    here = written(here.select("doc_id", "key", _without_lines("text", "_gone").alias("text"), "_gone"), "left")
    return here.unionAll(keyed.filter("NOT _hit").select("doc_id", "key", "text", F.lit(None).cast("array<int>").alias("_gone")))


def passages(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, min_words: int = MIN_WORDS) -> DataFrame:
    """The places of paragraphs as in `repeated`, with no start, and of the `runs` in what these leave."""
    with temporary(docs.sparkSession):
        places = written(repeated(docs, n, num, den, min_words), "places", stays=True)
    more = runs(_left(docs, _gone(places)))
    return places.withColumn("start", F.lit(None).cast("int")).unionByName(more)


def without_runs(text: str | None, cuts: list | None) -> str | None:
    """The text without runs (start, n_words) of its words. The blanks on one side go as well: those before it where only behind it a line ends, or the text."""
    if not cuts or text is None:
        return text
    data = text.encode("utf-8")
    words = [m.span() for m in _WORD.finditer(data)]
    joined: list[list[int]] = []
    for a, n in sorted((c[0], c[1]) for c in cuts):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], a + n)
        else:
            joined.append([a, a + n])
    out, done = [], 0
    for a, b in joined:
        before = words[a - 1][1] if a else 0
        start, stop = words[a][0], words[b - 1][1]
        if b == len(words) or b"\n" in data[stop : words[b][0]] and b"\n" not in data[before:start] and a:
            start = max(before, done)
        else:
            stop = words[b][0]
        out.append(data[done:start])
        done = stop
    return b"".join([*out, data[done:]]).decode("utf-8")


def _lost(docs: DataFrame, n: int, num: int, den: int, min_words: int) -> DataFrame:
    """_id, _key, _gone (lines), _cuts (runs) of the documents that lose something."""
    with temporary(docs.sparkSession):  # what paragraphs took is let go before runs are looked for
        gone = _gone(repeated(docs, n, num, den, min_words), stays=True)
    cuts = runs(_left(docs, gone)).filter("removed").groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n_words")).alias("_cuts"))
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.lit(None).cast("array<int>").alias("_gone"), "_cuts")
    both = gone.withColumn("_cuts", F.lit(None).cast(cuts.schema["_cuts"].dataType)).unionByName(cuts)
    return both.groupBy("_id", "_key").agg(F.first("_gone", True).alias("_gone"), F.first("_cuts", True).alias("_cuts"))


def cleaned(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the passages that stand elsewhere first; columns as they were. Only documents that lose something are shuffled."""
    with temporary(docs.sparkSession):
        lost = written(_lost(docs, n, num, den, min_words), "lost", stays=True)
    # a row's own columns are one struct here, so none of their names can clash
    whole = docs.select(F.struct("*").alias("whole"), "text", F.xxhash64("text").alias("key"), F.col("doc_id").cast("long").alias("id"))
    keyed = flagged(whole, ["key"], lost.select(mark_of("_key").alias("mark")))
    here = keyed.filter("_hit").join(lost, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    cut = F.udf(without_runs, "string", useArrow=True)
    changed = here.withColumn("text", cut(_without_lines("text", "_gone"), F.col("_cuts")))
    own = {c: F.col("whole").getField(c) for c in docs.columns}
    if "n_chars" in own:
        same = F.col("_gone").isNull() & F.col("_cuts").isNull()
        own["n_chars"] = F.when(same, own["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    own["text"] = F.col("text")
    return changed.select(*(x.alias(c) for c, x in own.items())).unionAll(keyed.filter("NOT _hit").select("whole.*"))
