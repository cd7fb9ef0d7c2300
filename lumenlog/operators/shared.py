"""Tables that operators with several rounds store between them, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir. Where that is unset, a temporary folder becomes it on a local master; a cluster gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lumenlog-")
        atexit.register(shutil.rmtree, own, True)
        spark.conf.set("spark.checkpoint.dir", root := f"file://{own}")
    return f"{root.rstrip('/')}/lumenlog-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written and read back: what comes after it starts from a table, and a lost executor costs nothing before it."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        for folder_ in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder_)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
