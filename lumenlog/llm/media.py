"""Operator 10, media columns: FLAC.

`encoded` turns a text's bytes (zeros up to a positive multiple of 64) into a column of FLAC streams: each frame has the fixed predictor or the linear one of order
LPC_ORDER, whichever takes fewer bits. `decoded` reads those stored bytes, checks
every checksum and gives PCM blocks with the number of their first sample, so that `samples` reads any
stretch without the blocks before it. Texts stream through in small batches; there is no shuffle.

`media_features` stores the streams, reads them back, stores the PCM blocks and reads these back. Streams of text hardly compress, so it goes in WAVES, each the texts whose hash
falls to it: a wave's streams are deleted when its blocks are written, and the disk holds those of one wave only.

Defined results: a null text is an empty one (64 zero bytes); a null doc_id is kept; equal texts give equal values; repeated
rows are kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm import flac
from lumenlog.llm.shared import temporary, written

ROWS = 1024
LPC_ORDER = 4
WAVES = 4
MEDIA = "doc_id long, n_bytes long, media binary"
PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<first_sample: long, pcm: binary>>"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, filled up, and their number before that."""
    data = (text or "").encode("utf-8")
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data)), len(data)


def samples(blocks: list[dict], start: int, stop: int) -> bytes:
    """Samples [start, stop), from the blocks that hold them."""
    firsts = [b["first_sample"] for b in blocks]
    a = max(0, int(np.searchsorted(firsts, start, side="right")) - 1)
    b = int(np.searchsorted(firsts, stop, side="left"))
    return b"".join(x["pcm"] for x in blocks[a:b])[start - firsts[a] :][: stop - start]


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the FLAC stream of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                held = [payload(t) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([n for _, n in held], pa.int64()), pa.array([flac.encode(p, LPC_ORDER) for p, _ in held], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEDIA)


def decoded(media: DataFrame) -> DataFrame:
    """The PCM blocks of each stream, checked."""
    kind = pa.list_(pa.struct([("first_sample", pa.int64()), ("pcm", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                streams = piece.column("media").to_pylist()
                found = flac.decode_all(streams)
                flat = [b for x in found for b in x]
                firsts = np.concatenate([np.concatenate([[0], np.cumsum([len(b) for b in x])[:-1]]) for x in found]).astype(np.int64)
                blocks = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([pa.array(firsts), pa.array(flat, pa.binary())], names=["first_sample", "pcm"]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("n_bytes"), pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams]), blocks.cast(kind)],
                    names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"],
                )

    return media.mapInArrow(run, PCM)


def features(pcm: DataFrame) -> DataFrame:
    """What the blocks that were read back hold: checksums, and peak, sum and sign changes of the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                rows = []
                for r in piece.to_pylist():
                    data = b"".join(b["pcm"] for b in r["blocks"])
                    s = (np.frombuffer(data, np.uint8) ^ 0x80).view(np.int8)
                    changes = int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), f"peak={max(int(s.max()), -int(s.min()))};sum={int(s.sum(dtype=np.int64))};sign_changes={changes}"))
                n, sha, crc, text = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("n_bytes"), pa.array(n, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()), piece.column("media_bytes"), piece.column("media_sha256"), pa.array(text)],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return pcm.mapInArrow(run, FEATURES)


def media_features(docs: DataFrame, waves: int = WAVES) -> DataFrame:
    """Encode, store the streams, decode them, store the PCM blocks, read them back and describe them; wave by wave."""
    pcm = []
    for wave in range(waves):
        with temporary(docs.sparkSession):
            streams = written(encoded(docs.filter(F.pmod(F.xxhash64("text"), F.lit(waves)) == wave)), "streams")
            pcm.append(written(decoded(streams), "pcm", stays=True))
    return features(functools.reduce(DataFrame.unionAll, pcm))
