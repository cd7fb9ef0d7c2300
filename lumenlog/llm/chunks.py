"""Words of many texts at once, in numpy: where they stand and their 64-bit hashes, without a Python object for each.

Hashes only bring equal words together. Who keeps a value for a word (`Table`, operators 1, 2, 4 and 5) compares the words' bytes: within a piece
of text by `Spans.distinct`, with what was seen before by a dictionary of the words themselves.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII white space.
WHITE = bytes([9, 10, 11, 12, 13, 32])
#: Words of more bytes are hashed by the library, one by one.
LONG = 256
#: Rows of a column that are Python's objects at a time.
STEP = 256
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_tables: dict[tuple, object] = {}


def released() -> None:
    """Lets go what the worker holds of all operators; tasks that need none of it begin with this (`lean`)."""
    if _tables:
        _tables.clear()
        trimmed()


def trimmed() -> None:
    """Freed memory goes back to the system: a worker waits for its next task beside the JVM and other workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that needs no operator's tables: it begins by letting them go and gives back at its end what it has freed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        yield from run(batches)
        trimmed()

    return task


def of_worker(kind: str, key, make: Callable):
    """The worker's own table of an operator, made once for all of its tasks. When another operator's first task comes, what the others
    held is let go: a worker serves all stages, and their tables together would not fit."""
    if (kind, key) not in _tables:
        released()
        _tables[kind, key] = make()
    return _tables[kind, key]


def _limbs(data: bytes) -> np.ndarray:
    """The 8 bytes from each byte on."""
    return np.ndarray((len(data) + 1,), "<u8", data + bytes(8), 0, (1,))


@dataclass
class Spans:
    """Words of joined texts: bytes, starts and ends, hashes, and the number of each text's first word."""

    data: bytes
    start: np.ndarray
    stop: np.ndarray
    key: np.ndarray
    first: np.ndarray

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]]

    def several(self, numbers: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.start[numbers].tolist(), self.stop[numbers].tolist())]

    def text(self, i: int) -> str:
        return self.bytes(i).decode("utf-8")

    def same_as(self, other: np.ndarray) -> np.ndarray:
        """Whether each word has the bytes of word other[i]."""
        limbs, size = _limbs(self.data), self.stop - self.start
        same = size == size[other]
        live = np.flatnonzero(same & (size > 0) & (size <= LONG) & (other != np.arange(len(size))))
        at, to, left = self.start[live], self.start[other[live]], size[live]
        while len(live):
            equal = ((limbs[at] ^ limbs[to]) & _MASK[np.minimum(left, 8)]) == 0
            same[live[~equal]] = False
            more = equal & (left > 8)
            live, at, to, left = live[more], at[more] + 8, to[more] + 8, left[more] - 8
        for i in np.flatnonzero(same & (size > LONG)).tolist():
            same[i] = self.bytes(i) == self.bytes(other[i])
        return same

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each that is different, and for each word the number of its like."""
        _, first, back = np.unique(self.key, return_index=True, return_inverse=True)
        if self.same_as(first[back]).all():
            return first, back
        seen: dict[bytes, int] = {}  # two words with one hash
        first, back = [], np.empty(len(self.key), np.int64)
        for i in range(len(self.key)):
            n = back[i] = seen.setdefault(self.bytes(i), len(seen))
            if n == len(first):
                first.append(i)
        return np.array(first, np.int64), back


class Hasher:
    """Splits at some bytes. A word's hash is mixed from its length and its bytes, eight at a time, so equal words have equal hashes in every process
    and words of up to eight bytes that have one length never share one."""

    def __init__(self, gaps: bytes = WHITE):
        self.gap = np.zeros(256, bool)
        self.gap[list(gaps)] = True
        self.joint = gaps[:1]

    @staticmethod
    def keys(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, stop) of bytes."""
        limbs, left = _limbs(data), stop - start
        h = left.astype(np.uint64) * _ODD[0]
        long = np.flatnonzero(left > LONG).tolist()
        live = np.flatnonzero((left > 0) & (left <= LONG))
        at, left = start[live], left[live]
        while len(live):
            x = (h[live] ^ limbs[at] & _MASK[np.minimum(left, 8)]) * _ODD[1]
            h[live] = x ^ x >> np.uint64(32)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in long:
            h[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]])
        h = (h ^ h >> np.uint64(30)) * _ODD[1]
        h = (h ^ h >> np.uint64(27)) * _ODD[2]
        return h ^ h >> np.uint64(31)

    def spans(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of what stands between gaps; the last byte is one."""
        gap = self.gap[x]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        return edge[0 : len(edge) // 2 * 2 : 2], edge[1::2]

    def __call__(self, held: list[bytes], lower: bool = False) -> Spans:
        data = self.joint.join(held) + self.joint
        data = data.lower() if lower else data
        start, stop = self.spans(np.frombuffer(data, np.uint8))
        bounds = np.cumsum([0, *(len(t) + 1 for t in held)])
        return Spans(data, start, stop, self.keys(data, start, stop), np.searchsorted(start, bounds))


def pieces_of(texts: list[str | None] | pa.Array, most: int = 1 << 20):
    """Texts as bytes, in stretches of about `most` bytes. Those of a column are taken from its bytes, STEP rows at a time, so that a batch is never held as Python's texts."""
    column = isinstance(texts, pa.Array)
    texts = texts.cast(pa.binary()) if column else texts
    some, size = [], 0
    for at in range(0, len(texts), STEP):
        rows = texts[at : at + STEP]
        for t in rows.to_pylist() if column else rows:
            held = (t or b"") if column else (t or "").encode("utf-8")
            if some and size + len(held) > most:
                yield some
                some, size = [], 0
            some.append(held)
            size += len(held)
    if some:
        yield some


def grown(x: np.ndarray) -> np.ndarray:
    """With room for as many again, which takes no memory until it is used."""
    out = np.zeros(2 * len(x), x.dtype)
    out[: len(x)] = x
    return out


def kept_units(seen: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """Numbers of the units that came twice at least; if they weigh over `most`, those that came oftener."""
    by_seen = np.bincount(seen, weights=weight, minlength=3)
    above = np.cumsum(by_seen[::-1])[::-1]  # what came so often or oftener weighs
    least = np.flatnonzero(above[2:] <= most)
    return np.flatnonzero(seen >= (int(least[0]) + 2 if len(least) else len(above)))


class Table:
    """A value for each distinct word that a worker has seen, computed once; when `most` words are held, the rare ones are let go."""

    def __init__(self, value, kind, most: int = 500_000):
        self.value, self.kind, self.most = value, kind, most
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.values, self.seen = np.zeros(1 << 12, self.kind), np.zeros(1 << 12, np.int64)

    def shrink(self) -> None:
        n = len(self.number)
        kept = kept_units(self.seen[:n], np.full(n, 1 / self.most), 0.5)
        keys = list(self.number)
        self.number = {keys[i]: at for at, i in enumerate(kept.tolist())}
        self.values[: len(kept)], self.seen[: len(kept)] = self.values[kept], self.seen[kept]
        self.seen[len(kept) :] = 0

    def __call__(self, spans: Spans) -> np.ndarray:
        """The value of each word."""
        first, back = spans.distinct()
        words = spans.several(first)
        if len(self.number) + len(words) > self.most:
            self.shrink()
        get = self.number.get
        numbers = np.array([get(w, -1) for w in words], np.int64)
        for i in np.flatnonzero(numbers < 0).tolist():
            n = numbers[i] = self.number[words[i]] = len(self.number)
            if n >= len(self.values):
                self.values, self.seen = grown(self.values), grown(self.seen)
            self.values[n] = self.value(words[i].decode("utf-8"))
        self.seen[numbers] += 1
        return self.values[numbers[back]]


class Lists:
    """Lists of numbers, one behind the other in an array that grows."""

    def __init__(self, kind):
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.used, self.n = np.zeros(1 << 14, kind), 0, 0

    def append(self, joined: np.ndarray, sizes: np.ndarray) -> None:
        """More lists, one behind the other, with their sizes."""
        while self.n + len(sizes) > len(self.first):
            self.first, self.size = map(grown, (self.first, self.size))
        while self.used + len(joined) > len(self.pool):
            self.pool = grown(self.pool)
        self.first[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(sizes)] = sizes
        self.pool[self.used : self.used + len(joined)] = joined
        self.used, self.n = self.used + len(joined), self.n + len(sizes)

    def joined(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one behind the other, and where each ends."""
        size = self.size[number]
        end = np.cumsum(size)
        place = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size, size)
        return self.pool[np.repeat(self.first[number], size) + place], end
