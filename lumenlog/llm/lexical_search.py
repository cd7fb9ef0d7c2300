"""Operator 11, ranked lexical search: Block-Max WAND over an inverted index in shards.

Index (`built`): every row of the documents is indexed. A task cuts what it reads into shards of SHARD_BYTES of text (or SHARD_DOCS rows), so texts
are never shuffled. A shard has one row for each of its terms, with the postings (document's number in the shard, frequency) in blocks of
BLOCK, compressed to variable bytes. Beside the blocks stand each one's first and last document, its size and its maximum impact. One more row, without a
term, has the shard's document ids and lengths. The length norm needs two sums over all documents, which a first pass counts.

Search (`ranked`): the terms' document frequencies come from the index by one aggregation. Shards are dealt over tasks, with the rows of query terms only,
and a task takes its shards one by one and carries each query's k best from shard to shard. In a shard a query's lists move
shallowly first: begins and ends of blocks cut the documents into intervals, in which the sum of weight times maximum impact bounds every score, without reading a block. Intervals are taken by falling bound;
only blocks that reach into one whose bound is not below the k-th score are decompressed, once for all queries, and scored. A whole list
set whose bound is below is passed over. Bounds that equal the k-th score stay, as ties go to the smaller id. The tasks' lists, k rows a query each, meet in one ranked window.

Scores are whole numbers: see `impact` and `weight`. A posting's score does not depend on shards, so results are the same however the input is split.

Defined results: a text without terms (also null) is no document; a query without terms, or whose terms are in no document, has no
rows; queries that share an id are one with the terms of all; rows that repeat are documents of their own, with ranks of their own; a null doc_id comes before
others on ties; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.chunks import Hasher, pieces_of
from lumenlog.llm.shared import written

BLOCK = 128
SHARD_BYTES = 1 << 24
SHARD_DOCS = 1 << 16
#: Queries that are sent to all tasks at once, in bytes of their terms; more go in further passes over the index.
CHUNK_BYTES = 1 << 24
#: Intervals that are scored first; after that each step takes four times as many.
FIRST = 16
#: Bytes that stand between terms: ASCII but digits and letters.
GAPS = bytes(b for b in range(128) if not chr(b).isalnum())
INDEX = "shard long, term binary, n long, first array<int>, last array<int>, top array<int>, size array<int>, held binary"
HITS = "item_id long, doc_id long, score long"
_hasher = Hasher(GAPS)


def norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The length norm of documents with n terms: 50 parts of 100, and 50 by length over mean length."""
    return np.array([50 + 50 * x * documents // max(1, terms) for x in n.tolist()], np.int64)


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term that comes tf times adds to a document's score, but for its weight; below 1,000,000."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * norm)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def packed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits each, the lowest first; and how many bytes each one takes."""
    size = np.ones(len(v), np.int64)
    for k in range(1, 5):
        size += v >= 1 << 7 * k
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        out[start[live] + k] = v[live] >> 7 * k & 127 | (size[live] > k + 1) << 7
    return out, size


def unpacked(x: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(x < 128)
    start = np.concatenate([[0], end[:-1] + 1])[: len(end)]
    size, v = end - start + 1, np.zeros(len(end), np.int64)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        v[live] |= (x[start[live] + k] & 127).astype(np.int64) << 7 * k
    return v


class Builder:
    """One shard: texts in, index rows out."""

    def __init__(self, documents: int, terms: int):
        self.documents, self.terms = documents, terms
        self.number: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n, self.ids, self.bytes = [], [], 0

    def add(self, held: list[bytes], ids: list[int | None]) -> None:
        spans = _hasher(held, lower=True)
        n = np.diff(spans.first)
        if len(spans.start):
            first, back = spans.distinct()
            term = np.array([self.number.setdefault(spans.bytes(i), len(self.number)) for i in first.tolist()], np.int64)
            key, tf = np.unique(term[back] * len(held) + np.repeat(np.arange(len(held)), n), return_counts=True)
            self.parts.append(((key // len(held)).astype(np.int32), (key % len(held) + len(self.ids)).astype(np.int32), tf.astype(np.int32)))
        self.n.append(n)
        self.ids += ids
        self.bytes += sum(map(len, held))

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        n = np.concatenate(self.n)
        norm, ids = norms(n, self.documents, self.terms), np.array([i or 0 for i in self.ids], np.int64)
        none = np.array([i is None for i in self.ids], np.uint8)
        yield _batch(shard, [None], [int((n > 0).sum())], [0], [], [], [], [], [ids.tobytes() + norm.tobytes() + none.tobytes()])
        if not self.parts:
            return
        names = sorted(self.number)
        place = np.empty(len(names), np.int64)
        place[[self.number[x] for x in names]] = np.arange(len(names))
        term, doc, tf = (np.concatenate(x) for x in zip(*self.parts))
        self.parts.clear()
        term = place[term]
        order = np.argsort(term, kind="stable")  # documents rise in each term already
        term, doc, tf = term[order], doc[order].astype(np.int64), tf[order].astype(np.int64)
        count = np.bincount(term, minlength=len(names))
        first = np.cumsum(count) - count
        step = np.diff(doc, prepend=-1) - 1
        step[first] = doc[first]
        begin = np.flatnonzero((np.arange(len(doc)) - first[term]) % BLOCK == 0)
        held, size = packed(np.column_stack([step, tf - 1]).ravel())
        of_block = np.add.reduceat(size.reshape(-1, 2).sum(1), begin)
        blocks = -(-count // BLOCK)
        top = np.maximum.reduceat(impact(tf, norm[doc]), begin)
        last = doc[np.append(begin[1:], len(doc)) - 1]
        upto = np.concatenate([[0], np.cumsum(of_block)])[np.concatenate([[0], np.cumsum(blocks)])].tolist()
        data = held.tobytes()
        yield _batch(shard, names, count, blocks, doc[begin], last, top, of_block, [data[a:b] for a, b in zip(upto, upto[1:])])


def _batch(shard: int, terms: list, n, blocks, first, last, top, size, held: list[bytes]) -> pa.RecordBatch:
    at = pa.array(np.concatenate([[0], np.cumsum(blocks)]), pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(np.asarray(x, np.int32))) for x in (first, last, top, size)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), shard)), pa.array(terms, pa.binary()), pa.array(n, pa.int64()), *lists, pa.array(held, pa.binary())], names=["shard", "term", "n", "first", "last", "top", "size", "held"])


def lengths(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have, with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = terms = 0
            for held in pieces_of(batch.column(0)):
                start, _ = _hasher.spans(np.frombuffer(_hasher.joint.join(held) + _hasher.joint, np.uint8))
                n = np.diff(np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in held)])))
                documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])

    return tuple(docs.select("text").mapInArrow(run, "documents long, terms long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first())


def built(docs: DataFrame) -> DataFrame:
    """The index of doc_id and text, stored in the shared folder."""
    documents, terms = lengths(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = TaskContext.get().partitionId() << 32, Builder(documents, terms)
        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for held in pieces_of(batch.column("text")):
                now.add(held, ids[at : at + len(held)])
                at += len(held)
                if now.bytes >= SHARD_BYTES or len(now.ids) >= SHARD_DOCS:
                    yield from now.rows(shard)
                    shard, now = shard + 1, Builder(documents, terms)
        if now.ids:
            yield from now.rows(shard)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "postings")


class Postings:
    """A term's list in a shard; blocks are decompressed when they are asked for, once."""

    def __init__(self, n: int, first: np.ndarray, last: np.ndarray, top: np.ndarray, size: np.ndarray, held: bytes, norm: np.ndarray):
        self.first, self.last, self.top, self.norm, self.n = first, last, top.astype(np.int64), norm, n
        self.bytes, self.stop = np.frombuffer(held, np.uint8), np.cumsum(size)
        self.most, self.read = int(top.max()), np.zeros(len(last), bool)
        self.doc, self.score = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def block(self, bounds: np.ndarray) -> np.ndarray:
        """Shallow move: the block in whose reach each of the documents is; one more than there are where none is."""
        at = np.searchsorted(self.last, bounds)
        return np.where(np.append(self.first, 0)[at] <= bounds, at, len(self.last))

    def places(self, blocks: np.ndarray) -> np.ndarray:
        """Where the postings of these blocks stand, decompressed."""
        new = blocks[~self.read[blocks]]
        if len(new):
            start = self.stop[new - 1] * (new > 0)
            size = self.stop[new] - start
            v = unpacked(self.bytes[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))])
            at, count = self._at(new)
            step, before = v[0::2] + 1, np.where(new > 0, self.last[new - 1], -1)
            run = np.cumsum(step)
            begin = np.cumsum(count) - count
            self.doc[at] = run + np.repeat(before - (run[begin] - step[begin]), count)
            self.score[at] = impact(v[1::2] + 1, self.norm[self.doc[at]])
            self.read[new] = True
        return self._at(blocks)[0]

    def _at(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.minimum(BLOCK, self.n - blocks * BLOCK)
        return np.repeat(blocks * BLOCK - (np.cumsum(count) - count), count) + np.arange(int(count.sum())), count


@dataclass
class Best:
    """A query's best documents so far."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    none: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint8))

    @property
    def least(self) -> int:
        """A score below this one is of no use."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def keep(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        score, doc, none = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.none, none)))
        if len(score) > 4 * self.k:  # only what reaches the k-th score has to be put in order
            some = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, doc, none = score[some], doc[some], none[some]
        first = np.lexsort((doc, none == 0, -score))[: self.k]
        self.score, self.doc, self.none = score[first], doc[first], none[first]


class Shard:
    """The query terms' lists of one shard."""

    def __init__(self, held: bytes):
        n = len(held) // 17
        self.ids, self.norm, self.none = np.frombuffer(held, np.int64, n), np.frombuffer(held, np.int64, n, 8 * n), np.frombuffer(held, np.uint8, n, 16 * n)
        self.lists: dict[bytes, Postings] = {}
        self.sum = np.zeros(n, np.int64)

    def search(self, terms: list[tuple[bytes, int]], best: Best) -> None:
        own = [(w, p) for t, w in terms if (p := self.lists.get(t)) is not None]
        if not own or sum(w * p.most for w, p in own) < best.least:
            return
        bounds = np.unique(np.concatenate([x for _, p in own for x in (p.first - 1, p.last)]))
        upper = np.zeros(len(bounds), np.int64)
        for w, p in own:
            upper += w * np.append(p.top, 0)[p.block(bounds)]
        order = np.argsort(-upper, kind="stable")
        interval, at, n = np.searchsorted(bounds, np.arange(len(self.ids))), 0, FIRST
        while at < len(order) and upper[order[at]] >= best.least:
            some = order[at : at + n]
            self._score(own, bounds, some[upper[some] >= best.least], interval, best)
            at, n = at + n, 4 * n

    def _score(self, own: list[tuple[int, Postings]], bounds: np.ndarray, some: np.ndarray, interval: np.ndarray, best: Best) -> None:
        chosen = np.zeros(len(bounds) + 1, bool)
        chosen[some] = True
        ends = bounds[np.sort(some)]
        for w, p in own:
            blocks = p.block(ends)
            blocks = blocks[blocks < len(p.last)]
            at = p.places(blocks[np.diff(blocks, prepend=-1) > 0])
            at = at[chosen[interval[p.doc[at]]]]
            self.sum[p.doc[at]] += w * p.score[at]
        hit = np.flatnonzero(self.sum)
        enough = hit[self.sum[hit] >= best.least]
        best.keep(self.sum[enough], self.ids[enough], self.none[enough])
        self.sum[hit] = 0


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Rows that come by shard, each shard's own row first."""
    now, number = None, None
    for batch in batches:
        lists = [batch.column(c) for c in ("first", "last", "top", "size")]
        flat = [x.values.to_numpy() for x in lists]
        at, held = lists[0].offsets.to_numpy(), batch.column("held")
        for i, (shard, term, n) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("term").to_pylist(), batch.column("n").to_pylist())):
            if shard != number:
                if now is not None:
                    yield now
                now, number = Shard(held[i].as_py()), shard
            else:
                now.lists[term] = Postings(n, *(x[at[i] : at[i + 1]] for x in flat), held[i].as_py(), now.norm)
    if now is not None:
        yield now


def terms_of(queries: DataFrame) -> DataFrame:
    """item_id, terms: the distinct terms of each id's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set((t or "").encode("utf-8").lower().translate(bytes(32 if b in GAPS else b for b in range(256))).split(b" ")) - {b""}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    own = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<binary>")
    return own.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).filter(F.size("terms") > 0)


def ranked(index: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best documents with a score above 0. queries: item_id, text."""
    spark = index.sparkSession
    documents = index.filter("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    asked = written(terms_of(queries), "queries")
    n_bytes = asked.agg(F.coalesce(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t) + 8)), F.lit(0))).first()[0]
    chunks, parts = -(-n_bytes // CHUNK_BYTES), []
    for chunk in range(chunks):
        items = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == chunk)
        terms = items.select(F.explode("terms").alias("term")).distinct()
        df = {bytes(t): n for t, n in index.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.sum("n")).collect()}  # of one chunk's terms
        held = [(r.item_id, [(bytes(t), w) for t in r.terms if bytes(t) in df and (w := weight(documents, df[bytes(t)])) > 0]) for r in items.collect()]
        sent = spark.sparkContext.broadcast(sorted(held, key=lambda x: (x[0] is not None, x[0])))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = [Best(k) for _ in sent.value]
            for shard in shards(batches):
                for (_, own), b in zip(sent.value, best):
                    shard.search(own, b)
            for (item, _), b in zip(sent.value, best):
                if n := len(b.score):
                    yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array(b.doc, mask=b.none.astype(bool)), pa.array(b.score)], names=["item_id", "doc_id", "score"])

        wanted = terms.unionAll(spark.createDataFrame([(None,)], "term binary"))  # and the shards' own rows
        rows = index.join(F.broadcast(wanted), index.term.eqNullSafe(wanted.term), "left_semi")
        # a set number of tasks: by bytes alone few tasks would get all shards, and searching costs more than reading
        parts.append(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", F.asc_nulls_first("term")).mapInArrow(search, HITS))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionAll(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
