"""Operator 3, exact top-k search by inner product: columnar branch-and-bound.

Candidates stream through in blocks that are laid out by dimension. For a query the products are added up one group of
dimensions after the other; after each group the rest can add no more than (length of the query's remaining
part) * (length of the candidate's remaining part), and candidates whose sum and bound stay below the k-th best score so
far are squeezed out of the arrays. What is left at the end has exact integer scores.

Queries are taken in chunks of bounded bytes (`CHUNK_BYTES`); a chunk is broadcast and meets every candidate, so a larger
query set costs more passes and never more memory.

Components are held as doubles whose floor is a whole number; sums are added up in doubles where all stay below 2**52, else in longs where all stay
below 2**62, else in whole numbers of any size, without bounds. Vectors with a component of LARGE or more are kept apart from the others, so a few of them slow down
only themselves.

Defined results: components become floor(1024 * x). Vectors that are null, hold null, NaN or infinite components,
or have a null id, take no part. A score beyond a long is told as the nearest long, and such scores are ranked as doubles.
A query meets the vectors of its own length. Rows that repeat a vec_id are candidates each; a query's own vec_id is none;
a query id that repeats is answered once, by its smallest vector. Equal scores: the smaller vec_id first. An
empty table, or one without queries, gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BYTES = 16 << 20
GROUP = 8
BLOCK = 8192
LARGE = 1 << 17
HITS = "query_id long, vec_id long, score long, reach double"


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that take part, as doubles, not yet scaled."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def whole(x: float) -> int:
    """floor(1024 * x), where the product may leave a double."""
    return int(x) * 1024 if abs(x) >= 1 << 53 else math.floor(x * 1024)


def _matrices(ids: pa.Array, vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and rows of whole numbers, for each length of vectors, those with a large component apart: these are Python's numbers."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    ids = ids.to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        held = vectors if len(at) == len(lengths) else vectors.take(pa.array(at))
        rows = held.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))
        large = (np.abs(rows) >= LARGE).any(1)
        if not large.all():
            yield ids[at[~large]], np.floor(rows[~large] * 1024).astype(np.int64)
        if large.any():
            yield ids[at[large]], np.array([[whole(x) for x in r] for r in rows[large].tolist()], object)


class Queries:
    """The queries of one length, with their dimensions in the order in which their mass falls."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.k, self.large = ids, k, rows.dtype == object
        self.scores = [np.empty(0, np.int64)] * len(ids)
        self.found = [np.empty(0, np.int64)] * len(ids)
        self.given = rows
        if self.large:
            return
        self.order = np.argsort(-(rows.astype(np.float64) ** 2).sum(0), kind="stable")
        self.rows = rows[:, self.order]
        self.groups = [slice(a, min(a + GROUP, rows.shape[1])) for a in range(0, rows.shape[1], GROUP)]
        mass = self.rows.astype(np.float64) ** 2
        self.rest = np.array([np.sqrt(mass[:, g.stop :].sum(1)) for g in self.groups]).reshape(len(self.groups), len(ids))

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if self.large or rows.dtype == object:
            return self._any_size(ids, rows)
        most = [int(np.abs(x).max(initial=0)) for x in (self.given, rows)]
        if most[0] * most[1] * rows.shape[1] >= 1 << 62:  # from 2**8 dimensions on
            return self._any_size(ids, rows)
        for at in range(0, len(ids), BLOCK):
            self._block(ids[at : at + BLOCK], np.ascontiguousarray(rows[at : at + BLOCK, self.order].T))

    def _block(self, ids: np.ndarray, columns: np.ndarray) -> None:
        largest = max((int(np.abs(x).max(initial=0)) for x in (columns, self.rows)), default=0)
        kind = np.float64 if largest * largest * max(1, len(columns)) < 1 << 52 else np.int64  # sums of such products are exact in either
        columns, rows = columns.astype(kind), self.rows.astype(kind)
        mass = columns.astype(np.float64) ** 2
        rest = [np.sqrt(mass[g.stop :].sum(0)) for g in self.groups]
        start = rows[:, self.groups[0]] @ columns[self.groups[0]] if self.groups else np.zeros((len(self.ids), len(ids)), kind)
        for q, own in enumerate(self.ids):
            least = self.scores[q][-1] if len(self.scores[q]) == self.k else None
            left = np.flatnonzero(ids != own)
            sums = start[q][left]
            for g, group in enumerate(self.groups):
                if g:
                    sums = sums + rows[q, group] @ columns[group][:, left]
                if least is not None:
                    kept = sums + self.rest[g, q] * rest[g][left] * (1 + 1e-9) + np.abs(sums) * 1e-12 + (1 + abs(float(least)) * 1e-12) >= float(least)
                    if not kept.all():
                        left, sums = left[kept], sums[kept]
                if not len(left):
                    break
            if len(left):
                self._keep(q, sums.astype(np.int64), ids[left])

    def _keep(self, q: int, scores: np.ndarray, found: np.ndarray) -> None:
        """The k best of what query q has and these."""
        scores, found = np.concatenate([self.scores[q], scores]), np.concatenate([self.found[q], found])
        if scores.dtype == object:
            best = sorted(range(len(scores)), key=lambda i: (-scores[i], found[i]))[: self.k]
        else:
            if len(scores) > 4 * self.k:  # only what reaches the k-th score has to be put in order
                reach = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                scores, found = scores[reach], found[reach]
            best = np.lexsort((found, -scores))[: self.k]
        self.scores[q], self.found[q] = scores[best], found[best]

    def _any_size(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """The scores as Python's numbers, all of them."""
        for q, own in enumerate(self.ids.tolist()):
            others = ids != own
            x = self.given[q].astype(object)
            self._keep(q, np.array([int(sum(x * r)) for r in rows[others].astype(object)], object), ids[others])

    def hits(self) -> pa.RecordBatch:
        n, scores = [len(x) for x in self.found], [s for x in self.scores for s in x.tolist()]
        reach = [float(s) if abs(s) < 1 << 1000 else (math.inf if s > 0 else -math.inf) for s in scores]
        told = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n), pa.int64()), pa.array(np.concatenate([*self.found, np.empty(0, np.int64)]), pa.int64()), pa.array(told, pa.int64()), pa.array(reach, pa.float64())], names=["query_id", "vec_id", "score", "reach"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query among all rows of other ids."""
    spark = vectors.sparkSession
    rows = scaled(vectors)
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_bytes = queries.agg(F.coalesce(F.sum((F.size("v") + 1) * 8), F.lit(0))).first()[0]
    chunks = -(-n_bytes // CHUNK_BYTES)
    parts = []
    for chunk in range(chunks):
        held = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == chunk).toArrow().combine_chunks()
        if not held.num_rows:
            continue
        sent = spark.sparkContext.broadcast(list(_matrices(held.column("vec_id").combine_chunks(), held.column("v").combine_chunks())))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = [Queries(ids, x, k) for ids, x in sent.value]
            for batch in batches:
                for ids, x in _matrices(batch.column("vec_id"), batch.column("v")):
                    for q in held:
                        if q.given.shape[1] == x.shape[1]:
                            q.meet(ids, x)
            yield from (q.hits() for q in held)

        parts.append(rows.mapInArrow(search, HITS))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionAll(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("reach"), F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
