"""The driver gives back what it has freed."""

import re
from pathlib import Path

from lumenlog.llm.shared import temporary


def _mb(pid: int) -> float:
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_freed_native_memory_of_the_drivers_jvm_goes_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    spark.range(1).count()
    held = [jvm.java.util.zip.Deflater() for _ in range(1500)]  # some 260 KB each outside the heap
    for i, x in enumerate(held):
        if i % 10:  # the rest keeps the freed memory from being the heap's end
            x.end()
    jvm.System.gc()
    before = _mb(pid)
    with temporary(spark):
        pass
    assert _mb(pid) < before - 60
    for x in held[::10]:
        x.end()
