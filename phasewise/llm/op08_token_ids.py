"""Token-id output in a compressed binary format, by the coder of ``coder.py``.

Documents are range-partitioned and sorted by doc_id, encoded with a tokenizer file where they lie,
and each task writes its ids as segments: whole documents, about SEGMENT ids. A segment holds the ids
of its documents, their lengths, and independently reset, checksummed blocks of coded ids. Spark's own
writer commits the files, so lost executors and repeated tasks leave no half files, and readers need
no path of the machine. Every segment, and every block inside it, can be read alone.

The tokenizer splits at white space and never looks across it (a test compares with whole texts), so
each distinct word of a task is encoded once by the library and its ids are reused.

Edge cases: null text counts as empty: only the end id; rows that repeat are written again, ordered
by text where doc_ids are equal; null doc_ids come first; an empty table writes no segment; other
columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasewise.llm.coder import BLOCK, LANES, decode, encode
from phasewise.llm.common import join_checked, shared_path

END_ID = 1
SEGMENT = BLOCK * LANES
CACHE_WORDS = 300_000

SEGMENTS = (
    "part int, segment int, ids bigint, docs array<bigint>, lengths array<bigint>, sizes array<int>, sums array<bigint>, bytes array<int>, payload binary"
)
NAMES = ["part", "segment", "ids", "docs", "lengths", "sizes", "sums", "bytes", "payload"]


class WordCache:
    """Ids of texts as little-endian 16-bit bytes; the library sees every distinct word once."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the format holds ids below 65,536")
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set().union(*split) - self.known.keys())
        if new:
            many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            for word, e in zip(new, many(new, add_special_tokens=False)):
                self.known[word] = np.array(e.ids, "<u2").tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def _write_task(spec):
    def run(batches):
        cache, end = WordCache(spec.value), np.array([END_ID], "<u2").tobytes()
        part, number, docs, pieces, count = TaskContext.get().partitionId(), 0, [], [], 0

        def segment():
            ids = np.frombuffer(b"".join(pieces), "<u2")
            payloads, sizes, sums = encode(ids)
            lengths = [len(p) // 2 for p in pieces]
            row = [part, number, len(ids), docs, lengths, sizes, sums, [len(p) for p in payloads], b"".join(payloads)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _KINDS)], NAMES)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 128):
                for doc, raw in zip(ids[at : at + 128], cache.encode(texts[at : at + 128].to_pylist())):
                    docs.append(doc)
                    pieces.append(raw + end)
                    count += len(raw) // 2 + 1
                    if count >= SEGMENT:
                        yield segment()
                        number, docs, pieces, count = number + 1, [], [], 0
        if docs:
            yield segment()

    return run


_I64, _I32 = pa.int64(), pa.int32()
_KINDS = [_I32, _I32, _I64, pa.list_(_I64), pa.list_(_I64), pa.list_(_I32), pa.list_(_I64), pa.list_(_I32), pa.binary()]


def write_ids(docs: DataFrame, tokenizer_file: str, path: str) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order below ``path``."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.select("doc_id", "text").mapInArrow(_write_task(spec), SEGMENTS).write.option("compression", "none").parquet(path)


def _blocks_of(payload: bytes, lengths: list[int]) -> list[bytes]:
    ends = np.cumsum(lengths)
    return [payload[e - n : e] for e, n in zip(ends.tolist(), lengths)]


def _read_task(ids: bool):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(i)[at].as_py() for i, n in enumerate(NAMES)}
                flat = decode(_blocks_of(row["payload"], row["bytes"]), row["sizes"], row["sums"]).astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(row["lengths"])])
                pieces = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                out = [
                    pa.array([row["part"]] * len(pieces), _I32), pa.array([row["segment"]] * len(pieces), _I32),
                    pa.array(row["docs"], _I64), pa.array(cuts[:-1], _I64), pa.array(row["lengths"], _I64),
                    pa.array([zlib.crc32(p.tobytes()) for p in pieces], _I64),
                ]
                names = ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if ids:
                    out.append(pa.array([p.tolist() for p in pieces], pa.list_(_I32)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files below ``path``."""
    table = spark.read.schema(SEGMENTS).parquet(path)
    kind = "part int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    rows = table.mapInArrow(_read_task(ids), kind)
    # ids before each segment: inside a part by its segments, before a part by the parts (one row a task)
    sizes = table.select("part", "segment", "ids")
    before = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    starts = sizes.withColumn("base2", F.coalesce(F.sum("ids").over(before), F.lit(0))).join(offsets, "part")
    starts = starts.select("part", "segment", (F.col("base") + F.col("base2")).alias("base"))
    out = join_checked(rows, starts, ["part", "segment"], "inner", 16)
    return out.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write the files to the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    path = shared_path(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer_file, path)
    return read_ids(docs.sparkSession, path, ids=False)
