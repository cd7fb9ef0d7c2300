"""The shared folder: where tables that cut lineage are written."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from lumenlog.llm.chunks import lean, trimmed

ROWS = 1024
PIECES = 64


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir. Where the session has none, a temporary folder becomes it on a local master (tests); on a cluster that is an error,
    since executors would each write to their own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + (own := tempfile.mkdtemp(prefix="lumenlog-"))
        atexit.register(shutil.rmtree, own, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lumenlog-{uuid.uuid4().hex}"


_frames: list[list[str]] = []


def driver_trimmed(spark: SparkSession) -> None:
    """What the driver has freed goes back to the system: its Python's memory, and what the JVM's compiler and native libraries took outside
    the heap, which would else stay with each of hundreds of jobs. A JVM without that command keeps it."""
    trimmed()
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Py4JError, StopIteration):
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` stores meanwhile are deleted at the end, but for those written with `stays`, which belong to the frame around this one.

    Shuffle files go when the driver's garbage is collected, so that is asked for here: at the end of a step that has shuffled sets. The driver then gives freed memory back.
    """
    _frames.append([])
    try:
        yield
    finally:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        for name in _frames.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        driver_trimmed(spark)


def written(df: DataFrame, name: str = "table", codec: str = "zstd", stays: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage is a table that every executor sees."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if len(_frames) > stays:
        _frames[-1 - stays].append(folder)
    df.write.option("compression", codec).parquet(f"{folder}/{name}")
    driver_trimmed(spark)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def counted(texts: DataFrame, places: Callable[[list], np.ndarray], size: int) -> np.ndarray:
    """How often each of `size` places comes up over all rows of a one-column table.

    `places` gives the places (0 to size - 1) of a list of values, one for each time. A task adds up what it reads; the sums go out in
    PIECES pieces of the table and meet by piece, so that what moves follows the number of tasks, and what comes to the driver is
    8 bytes a place whatever the input.
    """
    step = -(-size // PIECES)
    schema = "piece int, held binary"

    def rows(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["piece", "held"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(step * PIECES, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found = places(batch.column(0).slice(at, ROWS).to_pylist())
                if 8 * len(found) > size:
                    total += np.bincount(found, minlength=len(total))
                else:
                    np.add.at(total, found, 1)
        yield from rows({i: x for i in range(PIECES) if (x := total[i * step : (i + 1) * step]).any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, held in zip(batch.column("piece").to_pylist(), batch.column("held").to_pylist()):
                x = np.frombuffer(zlib.decompress(held), np.int64)
                total[piece] = total[piece] + x if piece in total else x
        yield from rows(total)

    out = np.zeros(step * PIECES, np.int64)
    for piece, held in texts.mapInArrow(lean(count), schema).repartition("piece").mapInArrow(lean(add), schema).collect():
        out[piece * step : (piece + 1) * step] += np.frombuffer(zlib.decompress(bytes(held)), np.int64)
    return out[:size]
