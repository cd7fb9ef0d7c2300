"""Search for many patterns of any length in one pass over a series.

Patterns become a trie of states. Rows are dealt by place into cells of STEP rows, each with as many rows of the next one as the longest pattern reaches over, so a cell is
searched by itself and a long key is many cells. In a cell all places go down the trie together, a level at a time: what is held is the places that still match, whatever the number and
length of patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import ARROW
from lumenlog.operators import blocks

STEP = 4096
#: Patterns that are sent to all tasks at once, in bytes of text; more take further passes.
PASS_BYTES = 1 << 26


class Trie:
    """Nodes and their children as one sorted list of (node, state); `sequence` has the pattern that ends in a node, or -1."""

    def __init__(self, patterns: list[str]):
        self.patterns, self.codes, children, ends = patterns, {}, {}, [-1]
        self.longest = 1
        for i, p in enumerate(patterns):
            states, node = p.split(ARROW), 0
            self.longest = max(self.longest, len(states))
            for s in states:
                key = node, self.codes.setdefault(s, len(self.codes))
                if key not in children:
                    children[key] = len(ends)
                    ends.append(-1)
                node = children[key]
            if len(states) > 1:
                ends[node] = i
        self.width = max(1, len(self.codes))
        ordered = sorted(children)
        self.keys = np.array([n * self.width + c for n, c in ordered], np.int64)
        self.child = np.array([children[k] for k in ordered], np.int64)
        self.sequence = np.array(ends, np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child by a state's code (-1: in no pattern), or -1."""
        if not len(self.keys):
            return np.full(len(node), -1)
        key = node * self.width + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((code >= 0) & (self.keys[at] == key), self.child[at], -1)

    def found(self, code: np.ndarray, stop: np.ndarray, start: np.ndarray, passable: np.ndarray | None, other: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """start, last row and pattern of each match. stop: for each row where its cell ends; passable: rows that one match may pass over, once, before a row of another state."""
        node = self.step(np.zeros(len(start), np.int64), code[start])
        at, passed = start, np.zeros(len(start), bool)
        while True:
            live = node >= 0
            start, at, node, passed = start[live], at[live], node[live], passed[live]
            if not len(start):
                return
            hit = self.sequence[node] >= 0
            if hit.any():
                yield start[hit], at[hit], self.sequence[node[hit]]
            near = np.flatnonzero(at + 1 < stop[at])
            parts = [(start[near], at[near] + 1, node[near], passed[near])]
            if passable is not None:
                far = near[~passed[near] & passable[at[near] + 1] & (at[near] + 2 < stop[at[near]])]
                far = far[code[at[far] + 2] != other]
                parts.append((start[far], at[far] + 2, node[far], np.ones(len(far), bool)))
            start, at, node, passed = (np.concatenate(x) for x in zip(*parts))
            node = self.step(node, code[at])


def occurrences(series: DataFrame, keys: list[str], patterns: DataFrame, other: str | None = None, most_skip: float = 0.0, block: Column | None = None) -> DataFrame:
    """keys, sequence, start_time, end_time of every place where a pattern's states (two or more) follow each other in intervals; starts may overlap.

    With `other`, one interval of that state, no longer than `most_skip` seconds, may stand between two states of the pattern; of two ends from one start the earlier counts. Rows are in
    order of start_time and ord; `block` (see `blocks`) cuts keys that are too long for a task while places are counted.
    """
    order = ("start_time", "ord")
    if block is None:
        placed = series.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    else:
        placed = blocks.numbered(series, keys, block, order, "_place")
    placed = placed.select(*keys, "_place", "start_time", "end_time", "state")
    wanted = patterns.select("sequence").filter("sequence IS NOT NULL").distinct()
    passes = max(1, -(-(wanted.agg(F.sum(F.octet_length("sequence"))).first()[0] or 0) // PASS_BYTES))
    out = None
    for part in range(passes):
        held = wanted if passes == 1 else wanted.filter(F.pmod(F.xxhash64("sequence"), F.lit(passes)) == part)
        some = _pass(placed, keys, Trie(sorted(r.sequence for r in held.collect())), other, most_skip)
        out = some if out is None else out.unionAll(some)
    return out.groupBy(*keys, "sequence", "start_time").agg(F.min("end_time").alias("end_time"))


def _pass(placed: DataFrame, keys: list[str], trie: Trie, other: str | None, most_skip: float) -> DataFrame:
    reach = trie.longest - (other is None)
    cell = F.expr(f"_place div {STEP}")
    firsts = [cell] + [cell - i for i in range(1, 1 + -(-reach // STEP))]
    back = F.filter(F.array(*firsts), lambda c: (c >= 0) & (F.col("_place") < (c + 1) * STEP + reach))
    dealt = placed.withColumn("_cell", F.explode(back)).repartition(*keys, "_cell").sortWithinPartitions(*keys, "_cell", "_place")
    sent = placed.sparkSession.sparkContext.broadcast(trie)
    schema = placed.select(*keys, F.lit("").alias("sequence"), "start_time", "end_time").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        code_of = trie.codes
        mark = code_of.get(other, -2)

        def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
            place, number = table.column("_place").to_numpy(), table.column("_cell").to_numpy()
            begin = np.flatnonzero(place == number * STEP)
            stop = np.repeat(np.append(begin[1:], len(place)), np.diff(np.append(begin, len(place))))
            states = table.column("state").combine_chunks().dictionary_encode()
            names = states.dictionary.to_pylist()
            look = np.array([code_of.get(x, -1) for x in names] + [-1], np.int64)
            index = states.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
            code, passable = look[index], None
            if other is not None:
                us = [table.column(c).cast(pa.int64()).to_numpy() for c in ("start_time", "end_time")]
                is_other = np.array([x == other for x in names] + [False])[index]
                passable = is_other & ((us[1] - us[0]) / 1e6 <= most_skip)
                code = np.where(is_other, mark, code) if mark == -2 else code
            for start, last, which in trie.found(code, stop, np.flatnonzero(place < (number + 1) * STEP), passable, mark):
                made = [table.column(k).take(pa.array(start)) for k in keys] + [pa.array([trie.patterns[i] for i in which.tolist()], pa.string()), table.column("start_time").take(pa.array(start)), table.column("end_time").take(pa.array(last))]
                yield from pa.table(made, names=[*keys, "sequence", "start_time", "end_time"]).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 2 * STEP:
                continue
            table = pa.Table.from_batches(held)
            begin = np.flatnonzero(table.column("_place").to_numpy() == table.column("_cell").to_numpy() * STEP)
            cut = int(begin[-1])  # the last cell may go on
            if cut:
                yield from search(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield from search(table)

    return dealt.mapInArrow(run, schema)
