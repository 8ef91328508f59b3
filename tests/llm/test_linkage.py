"""Lists of shared postings, packed on their way, against the same sums by Spark's aggregates."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from phasewise.llm import linkage

TOP = (1 << 48) - 1


def test_shared_lists_equal_aggregates(spark):
    rows = spark.range(0, 6000, 1, 5).select(
        F.when(F.col("id") % 3 == 0, F.shiftrightunsigned(F.xxhash64("id"), 16)).when(F.col("id") % 3 == 1, F.lit(TOP)).otherwise(F.col("id") % 700).alias("key"),
        F.shiftrightunsigned(F.xxhash64((F.col("id") * 7) % 900), 24).alias("h"),
    )
    want = rows.groupBy("key").agg(
        F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("c"), F.sum("h").alias("s"), F.bit_xor("h").alias("x")
    ).where("a < b")
    got = linkage.shared_lists(rows)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert linkage.shared_lists(rows.where("false")).count() == 0


def test_postings_and_sketches_travel_in_few_bytes():
    rng = np.random.default_rng(3)
    key, h = rng.integers(0, TOP, 50_000), rng.integers(0, 1 << 40, 50_000)
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(h)], ["key", "h"])
    for buckets in (64, 4096):  # however many parts there are
        sent = sum(c.nbytes for b in linkage._pack_task(buckets)([batch]) for c in b.columns)
        assert sent < len(key) * 14
    assert len(linkage.sketch(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))) * 8 == 1024


def test_packing_holds_little_beside_the_postings():
    import tracemalloc

    rng = np.random.default_rng(5)
    rows = 1 << 18
    batch = pa.RecordBatch.from_arrays([pa.array(rng.integers(0, TOP, rows)), pa.array(rng.integers(0, 1 << 40, rows))], ["key", "h"])
    tracemalloc.start()
    for _ in linkage._pack_task(64)([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * batch.nbytes


def test_tasks_give_back_what_they_freed():
    import re

    from phasewise.llm.common import tidy

    def held():
        with open("/proc/self/smaps_rollup", encoding="ascii") as f:
            return sum(map(int, re.findall(r"\nAnonymous:\s+(\d+)", f.read()))) / 1024

    pins = []

    def task(batches):
        pieces = [np.ones(8000) for _ in range(4000)]  # 256 MB in pieces that come from the heap
        pins.append(np.ones(8000))  # above them: the heap can't just end lower
        yield from batches
        del pieces

    before = held()
    assert list(tidy(task)(iter([1, 2]))) == [1, 2]
    assert held() - before < 64
