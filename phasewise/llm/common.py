"""Helpers of the corpus operators: stored tables, checked broadcasts, word hashes, components."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.session import ensure_checkpoint_dir

# Broadcast bound: rows times the width of a row in bytes.
BROADCAST_BYTES = 16 << 20
# Bytes of text handled by one numpy pass.
CHUNK_BYTES = 1 << 21

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares (``spark.checkpoint.dir``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from the files: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, width: int) -> bool:
    """Whether ``df`` holds at most BROADCAST_BYTES, rows of ``width`` bytes each; counts, never fetches."""
    limit = BROADCAST_BYTES // max(1, width)
    return df.limit(limit + 1).count() <= limit


def join_checked(left: DataFrame, right: DataFrame, on, how: str, width: int) -> DataFrame:
    """Equi-join that broadcasts ``right`` (a stored table) within the bound and shuffles beyond it.

    The shuffled form joins two plain exchanges, whose hot keys AQE splits.
    """
    return left.join(F.broadcast(right) if small(right, width) else right, on, how)


def tidy(task):
    """``task`` of a mapInArrow; the worker, which Spark keeps for later stages, then gives back what the task has freed."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not in every C library
                trim(0)

    return run


# --- words of Arrow text columns -------------------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Gaps for matching that ignores punctuation: every ASCII byte but letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    w = np.full(n, _STEP, np.uint64)
    w[0] = 1
    return np.multiply.accumulate(w)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def _chunk_words(chunk: np.ndarray, lower: bool, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = gaps[chunk]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lens = ends - starts
    body = chunk[~gap]
    first = np.cumsum(lens) - lens
    pos = np.arange(len(body)) - np.repeat(first, lens)
    value = (_BYTE_LOWER if lower else _BYTE)[body] * _powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(value, first) + lens.astype(np.uint64) * _STEP), starts


def doc_words(column: pa.Array, lower: bool = True, gaps: np.ndarray = _SPACE):
    """Yield (row, 64-bit hashes of its words) for every row, with bounded memory.

    Rows are taken together up to CHUNK_BYTES; a longer row is cut between words.
    """
    body, off = text_bytes(column)
    row, n = 0, len(off) - 1
    while row < n:
        last = int(max(row + 1, np.searchsorted(off, off[row] + CHUNK_BYTES, side="right") - 1))
        size = int(off[last] - off[row])
        if last == row + 1 and size > CHUNK_BYTES:
            yield row, _long_row(body[off[row] : off[last]], lower, gaps)
        else:
            # a space between rows, so that no word crosses rows
            here = off[row : last + 1] - off[row]
            joined = np.insert(body[off[row] : off[last]], here[1:-1], 32)
            bounds = here + np.arange(len(here))
            words, starts = _chunk_words(joined, lower, gaps)
            cuts = np.searchsorted(starts, bounds)
            for i in range(last - row):
                yield row + i, words[cuts[i] : cuts[i + 1]]
        row = last


def _long_row(body: np.ndarray, lower: bool, gaps: np.ndarray) -> np.ndarray:
    parts, at = [], 0
    while at < len(body):
        end = min(len(body), at + CHUNK_BYTES)
        if end < len(body):
            cut = np.flatnonzero(gaps[body[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word longer than the chunk: up to its end
                rest = np.flatnonzero(gaps[body[end:]])
                end = end + int(rest[0]) if len(rest) else len(body)
        parts.append(_chunk_words(body[at:end], lower, gaps)[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words: the whole sequence as one; none: empty."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    mult = _powers(width + 1)[1:]
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        out += words[j : n - width + 1 + j] * mult[j]
    return np.unique(mix(out))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_array(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrow list<int64> of unsigned 64-bit pieces."""
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = signed(np.concatenate(parts).astype(np.uint64, copy=False)) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def whole_groups(batches, keys: list[str], rows: int, most: int | None = None):
    """Arrow tables of ``rows`` rows or more that end with whole groups; input comes sorted by ``keys``.

    With ``most``, a table ends after that many rows even inside a group, so that long groups stream.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        while most is not None and held.num_rows > most:
            yield held.slice(0, most).combine_chunks()
            held = held.slice(most)
        if most is None and held.num_rows >= rows:
            held = held.combine_chunks()
            same = np.ones(held.num_rows, bool)
            for k in keys:
                v = held.column(k).to_numpy()
                same &= v == v[-1]
            done = 0 if same.all() else held.num_rows - int(np.argmin(same[::-1]))
            if done:
                yield held.slice(0, done).combine_chunks()
                held = held.slice(done).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


# --- connected components --------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges``; large-star, small-star rounds.

    Star centres may hold a third of all edges: minima are taken by map-side combined aggregates
    and attached by joins of plain exchanges, which AQE splits. Each round is a stored table.
    """
    e = store(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "edges")
    state = _digest(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # large-star: larger neighbours of u point to the least id around u
        large = both.where("v > u").join(least, "u").where("v > m").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = store(large.distinct(), "large")
        # small-star: u and its smaller neighbours point to the least of them
        low = store(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        pulled = large.join(low, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi")
        before, e = e, store(pulled.unionByName(low.select(F.col("m").alias("lo"), "hi")).distinct(), "edges")
        discard(before, least, large, low)
        last, state = state, _digest(e)
        if state == last:
            break
    centres = e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    out = store(e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(centres), "components")
    discard(e)
    return out


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())
