"""Bitmaps that narrow a search: their bits, and what the driver's Python takes to hold one."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm.common import bitmap, in_bitmap, prepare

HERE = Path("/proc/self")


def peak_mb() -> float:
    return int(re.search(r"VmHWM:\s+(\d+)", (HERE / "status").read_text()).group(1)) / 1024


@pytest.mark.parametrize("values", [[], [0, 1, 63, 64, 32767, 32768, 65535, -1, -(2**63), 2**63 - 1, 7, 7], range(-9000, 9000)])
def test_bits(spark, values):
    values = np.array(list(values), dtype=np.int64)
    got = bitmap(spark.createDataFrame([(int(v),) for v in values], "s long"))
    bits = len(got) * 64
    want = np.zeros(bits, dtype=bool)
    want[(values.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)] = True
    assert bits >= max(1 << 16, 8 * len(values)) and (np.unpackbits(got.view(np.uint8), bitorder="little") == want).all()
    assert in_bitmap(got, values).all()


def test_memory_of_the_driver(spark):
    prepare(spark)
    hashes = spark.range(0, 4_000_000, 1, 4).select(F.xxhash64("id").alias("s"))
    bitmap(hashes.limit(1000))
    (HERE / "clear_refs").write_text("5")  # the peak begins anew
    before = peak_mb()
    got = bitmap(hashes)
    assert got.nbytes == 4 << 20 and 3_700_000 < int(np.bitwise_count(got).sum()) < 4_000_000
    assert peak_mb() - before < 64
