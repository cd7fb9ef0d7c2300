"""Operator 1, token-ID output: fixed-width bit packing with block offsets.

A token file is a Parquet table of blocks. A block holds whole documents in ascending doc_id order; its
ids are packed at `width` bits each (the fewest that hold the vocabulary), little end first, so id i of a block
lies at bits [i * width, (i + 1) * width) of `payload`: one numpy call unpacks any slice, and a single id can be
read without its neighbours. `first_id` and `last_id` are the block's least and greatest doc_id. `starts` has the place of each document in its block, `base` the ids that stand
before the block in its part, and parts follow each other in ascending doc_id order.

Defined results: a null text is an empty one (only the end id); a null doc_id sorts first; rows that repeat a
doc_id are kept, ordered by text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.chunks import Hasher, Spans, of_worker, pieces_of

BLOCK_IDS = 1 << 16
CACHE_CHUNKS = 500_000
FILE_SCHEMA = "part int, block int, base long, n_ids long, width int, first_id long, last_id long, doc_ids array<long>, starts array<long>, payload binary"


def id_width(vocabulary: int) -> int:
    """Bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """Ids at `width` bits each, little end first; the last byte is filled up with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].reshape(-1), bitorder="little").tobytes()


def unpack_ids(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """The ids [start, stop) of a packed block; reads only the bytes that hold them."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", stop - start, start * width // 8).astype("<u4")
    first = start * width
    held = np.frombuffer(payload, np.uint8)[first // 8 : (stop * width + 7) // 8]
    bits = np.unpackbits(held, bitorder="little")[first % 8 :][: (stop - start) * width].reshape(-1, width)
    wide = np.zeros((stop - start, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class ChunkEncoder:
    """Ids of texts, by the chunks between blanks and line feeds.

    The tokenizer turns white space into one blank, composes characters (which a blank never takes part in) and
    drops blanks before it looks for words, so the ids of a text are those of its chunks one after the other. A letter ends a word of the
    tokenizer where a full stop or comma follows, so that mark at a chunk's end is looked up apart; and ASCII letters are lower-cased
    one by one, so they can be before. Chunks of a batch are found and hashed in numpy; each distinct chunk is looked up once, by its
    bytes, and what is new goes to the library, many words in one text.
    """

    def __init__(self, path: str, vocabulary: int, by_chunk: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
        self.by_chunk = by_chunk
        ids = {i: word.endswith("</w>") for word, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.ends = np.array([ids.get(i, False) for i in range(max(ids) + 1)]) if any(ids.values()) else None
        self.hasher = Hasher(b" \n")
        self.forget()

    def forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, self.kind), 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind) for x in found]

    def _words(self, stems: list[str]) -> list[np.ndarray]:
        """Ids of stems of letters: many in one text, which is cut behind the ids that end a word."""
        out = []
        for at in range(0, len(stems), 1024):
            some = stems[at : at + 1024]
            ids = self._library([" ".join(some)])[0]
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends)] if len(ends) == len(some) else self._library(some)
        return out

    def _learn(self, keys: list[bytes]) -> None:
        chunks = [k.decode("utf-8") for k in keys]
        plain = [i for i, c in enumerate(chunks) if c.isalpha()] if self.ends is not None else []
        rest = sorted(set(range(len(chunks))).difference(plain))
        for places, found in ((plain, self._words([chunks[i] for i in plain])), (rest, self._library([chunks[i] for i in rest]))):
            if not places:
                continue
            at, sizes, ids = len(self.seen), np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found)
            while at + len(found) > len(self.first):
                self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.first[at : at + len(found)] = self.used + np.cumsum(sizes) - sizes
            self.size[at : at + len(found)] = sizes
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.seen.update(zip((keys[i] for i in places), range(at, at + len(found))))

    def _piece(self, held: list[bytes]) -> list[np.ndarray]:
        data = b"\n".join(held) + b"\n"
        if b"<|" not in data:  # the name of a special token is not to be made by lower-casing
            data = data.lower()
        x = np.frombuffer(data, np.uint8)
        start, stop = self.hasher.spans(x)
        last, before = x[stop - 1], x[np.maximum(stop - 2, 0)] | 32
        marked = ((last == 46) | (last == 44)) & (stop - start > 1) & (before >= 97) & (before <= 122)
        stem = stop - marked
        spans = Spans(data, start, stem, self.hasher.keys(data, start, stem), start)
        at, back = spans.distinct()
        keys = [spans.bytes(i) for i in at.tolist()]
        if len(self.seen) + len(keys) > CACHE_CHUNKS:
            self.forget()
        number = np.fromiter(map(self.seen.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        if len(new):
            some = [keys[i] for i in new.tolist()]
            self._learn(some)
            number[new] = np.fromiter(map(self.seen.__getitem__, some), np.int64, len(new))
        number = number[back]
        size = self.size[number]
        end = np.cumsum(size + marked)
        ids = np.zeros(int(end[-1]) if len(end) else 0, self.kind)
        ids[end[marked] - 1] = np.where(last[marked] == 46, *self.marks)
        begin = end - size - marked
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        ids[np.repeat(begin, size) + place] = self.pool[np.repeat(self.first[number], size) + place]
        bounds = np.cumsum([len(t) + 1 for t in held])
        cut = np.concatenate([[0], np.concatenate([[0], end])[np.searchsorted(start, bounds)]])
        return [ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]

    @functools.cached_property
    def marks(self) -> tuple[int, int]:
        return tuple(int(x[0]) for x in self._library([".", ","]))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_chunk:
            return self._library(texts)
        return [ids for held in pieces_of(texts) for ids in self._piece(held)]


def encoder(tokenizer: str, vocabulary: int) -> ChunkEncoder:
    """The worker's own encoder; tasks that run one after the other in a worker share what it has seen."""
    return of_worker("encoder", (tokenizer, vocabulary), lambda: ChunkEncoder(_tokenizer_path(tokenizer), vocabulary))


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text, add `end_id` to each document, and write the blocks to `path`.

    Only the texts are shuffled, once, by ranges of doc_id; encoding and packing stream through the sorted
    partition, so a task holds one batch and one block. A file is committed by Spark's writer, so lost executors
    cost their tasks only.
    """
    width = id_width(vocabulary)
    if end_id >= 1 << width:
        raise ValueError("the end id does not fit the vocabulary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, block, base = encoder(tokenizer, vocabulary), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], encode.kind)
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        starts = [0]

        def closed() -> pa.RecordBatch:
            nonlocal block, base
            row = {"part": part, "block": block, "base": base, "n_ids": starts[-1], "width": width, "first_id": next((d for d in doc_ids if d is not None), None), "last_id": doc_ids[-1], "doc_ids": list(doc_ids), "starts": list(starts), "payload": pack_ids(np.concatenate(ids), width)}
            block, base = block + 1, base + starts[-1]
            ids.clear(), doc_ids.clear(), starts.__setitem__(slice(1, None), [])
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                for doc_id, found in zip(piece.column("doc_id").to_pylist(), encode(piece.column("text").to_pylist())):
                    ids += [found, end]
                    doc_ids.append(doc_id)
                    starts.append(starts[-1] + len(found) + 1)
                    if starts[-1] >= block_ids:
                        yield closed()
        if doc_ids:
            yield closed()

    (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(blocks, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .parquet(path)
    )


ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def part_starts(files: DataFrame) -> dict[int, int]:
    """Ids before each part; one number a written partition comes to the driver."""
    before, out = 0, {}
    for part, n in sorted(files.groupBy("part").agg(F.max(F.col("base") + F.col("n_ids"))).collect()):
        out[part], before = before, before + n
    return out


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32; every id is unpacked from the stored bits."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    before = part_starts(files)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = unpack_ids(row["payload"], row["width"], 0, row["n_ids"]).tobytes()
                starts = np.array(row["starts"], np.int64)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(before[row["part"]] + row["base"] + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """Random access: part, block, place, ids of each row of one document, unpacked from its own bits only.

    Blocks are in ascending doc_id order and hold their first and last id, so the scan skips files and row groups by the statistics of these two columns.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path).filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for i, d in enumerate(r["doc_ids"]):
                    if d == doc_id:
                        ids = unpack_ids(r["payload"], r["width"], r["starts"][i], r["starts"][i + 1])
                        yield pa.RecordBatch.from_pylist([{"part": r["part"], "block": r["block"], "place": i, "ids": ids.tolist()}], schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("place", pa.int32()), ("ids", pa.list_(pa.int64()))]))

    return blocks.mapInArrow(unpacked, "part int, block int, place int, ids array<long>")
