"""SimHash near-dedup by covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the 64-bit hashes of its word shingles. Every bit
position gets a vector of ``radius + 1`` bits; table ``v`` (every non-zero vector of that length) masks
the positions whose vector has odd overlap with ``v``. Positions in which two fingerprints differ, at most
``radius`` of them, span fewer than ``radius + 1`` dimensions, so some ``v`` is orthogonal to all of them and
its mask skips them all: every pair within the radius agrees on a whole mask and meets in that table.

The fingerprints are the exact data, so a bucket is verified where it lies and yields a spanning forest of
its links, never its pairs. Buckets beyond TILE members are cut into pairs of tiles. Fingerprints of buckets
beyond DENSE members meet by another exact rule whose work is linear: each posts all points within half
the radius of it, since two fingerprints within the radius share the point halfway; such a group holds no
more members than the ball has points.

Edge cases: null or empty text, or no word, has fingerprint zero, which links like any other; fewer words
than a shingle form one; texts of any length are hashed whole, PIECE bytes at a time; repeated rows repeat
in the result; rows that share a doc_id are one vertex; a row without doc_id keeps its fingerprint, has no
component and takes no part; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.llm.common import components, discard, join_checked, signed, store, whole_groups

SEED = 42
BITS = 64
TILE = 4096
DENSE = 8 * TILE
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# --- fingerprints ----------------------------------------------------------------------------------------------


def _pieces(body: bytes):
    """Words of a text in lists of about PIECE bytes; a word is never cut."""
    at = 0
    while at < len(body):
        gap = _SPACE.search(body, at + PIECE)
        end = gap.start() if gap else len(body)
        yield body[at:end].split()
        at = end


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    h = np.fromiter(hashes, "<u8", len(hashes))
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8), bitorder="little")
        total += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, words: int) -> int:
    """Majority of the shingle hashes of a text, repeats included; 0 without words."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, n, last = np.zeros(BITS, np.int64), 0, []
    for more in _pieces((text or "").encode().lower()):
        last += more
        if len(last) >= words:
            hashes = [digest(join(s), SEED) for s in zip(*(last[k:] for k in range(words)))]
            ones += _ones(hashes)
            n += len(hashes)
            last = last[len(last) - words + 1 :]
    if not n and last:
        return digest(join(last), SEED)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer, one row for each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(values))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


# --- covering masks --------------------------------------------------------------------------------------------


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector of ``radius + 1`` bits, as unsigned integers.

    Positions take the non-zero vectors in turn, so each mask holds about half of all positions.
    """
    tables = (1 << (radius + 1)) - 1
    vectors = [1 + p % tables for p in range(bits)]
    return [sum(1 << p for p in range(bits) if (vectors[p] & v).bit_count() & 1) for v in range(1, tables + 1)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def postings(fps: DataFrame, radius: int) -> DataFrame:
    """(t, v, fp): a row for each table and its masked fingerprint."""
    masks = F.array(*[F.lit(_long(m)) for m in covering_masks(radius)])
    rows = fps.select("fp", F.posexplode(masks).alias("t", "mask"))
    return rows.select(F.col("t").cast("tinyint").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("v"), "fp")


def ball(radius: int, bits: int = BITS) -> list[int]:
    """Patterns of at most ``radius`` bits: what leads from a point to all points that near."""
    return [sum(1 << p for p in c) for k in range(radius + 1) for c in combinations(range(bits), k)]


# --- links -----------------------------------------------------------------------------------------------------


def _forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints ``x`` (uint64, distinct) within the radius."""
    label = np.arange(len(x))
    left, right = [], []
    for i in range(len(x) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= radius)
        other, first = np.unique(label[near], return_index=True)
        fresh = other != label[i]
        if fresh.any():
            ends = near[first[fresh]]
            left.append(np.full(len(ends), i))
            right.append(ends)
            label[np.isin(label, other[fresh])] = label[i]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _bucket_task(radius: int, keys: list[str]):
    """Forests of buckets that arrive sorted by ``keys``."""

    def links(table: pa.Table):
        x = table.column("fp").to_numpy().view(np.uint64)
        change = np.zeros(len(x), bool)
        change[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [*np.flatnonzero(change).tolist(), len(x)]
        a, b = [], []
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s > 1:
                group = np.unique(x[s:e])
                i, j = _forest(group, radius)
                a.append(group[i])
                b.append(group[j])
        if a:
            a, b = signed(np.concatenate(a)), signed(np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        for table in whole_groups(batches, keys, 1):
            yield from links(table)

    return run


def _forests(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_bucket_task(radius, keys), "a bigint, b bigint")


def links(fps: DataFrame, radius: int = 4, tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """(a, b) stored: links whose components are those of all pairs of ``fps`` within the radius.

    ``fps`` is a stored table of distinct fingerprints ``fp``.
    """
    every = postings(fps, radius)
    buckets = every.groupBy("t", "v").agg(F.count("*").alias("c"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    buckets = store(buckets.where("c > 1"), "buckets")
    two = buckets.where("c = 2").where(F.expr(f"bit_count(a ^ b) <= {radius}")).select("a", "b")
    some = buckets.where(f"c > 2 AND c <= {dense}").select("t", "v", F.ceil(F.col("c") / tile).cast("int").alias("tiles"))
    member = join_checked(every, store(some, "some"), ["t", "v"], "inner", 16)
    member = member.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    member = member.select("t", "v", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = store(two.unionByName(_forests(member, ["t", "v", "i", "j"], radius)).distinct(), "found")
    crowded = store(buckets.where(f"c > {dense}").select("t", "v"), "crowded")
    if not crowded.isEmpty():
        held = join_checked(every, crowded, ["t", "v"], "left_semi", 16).select("fp").distinct()
        steps = F.array(*[F.lit(_long(p)) for p in ball(-(-radius // 2))])
        near = held.select("fp", F.explode(steps).alias("step")).select(F.col("fp").bitwiseXOR(F.col("step")).alias("v"), "fp")
        more = store(_forests(near, ["v"], radius).distinct(), "more")
        both = store(found.unionByName(more).distinct(), "links")
        discard(found, more)
        found = both
    discard(buckets, crowded)
    return found


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Documents link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest
    doc_id that links reach.
    """
    rows = store(fingerprints(docs, words), "rows")
    known = rows.where("doc_id IS NOT NULL")
    distinct = store(known.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    found = links(distinct.select("fp"), radius, tile, dense)
    # the fingerprints of one doc_id belong together
    several = store(known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z"), "several")
    shared = join_checked(known, several, "doc_id", "inner", 24).where("fp <> a").select("a", F.col("fp").alias("b"))
    linked = components(found.unionByName(shared)).select(F.col("id").alias("fp"), "component")
    labelled = distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    labelled = store(labelled, "labelled")
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = store(labelled.join(least, "component").select("fp", "component_id"), "named")
    out = join_checked(rows, named, "fp", "left", 16)
    out = out.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
    discard(found, several, labelled, distinct)
    return out


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with the rows whose doc_id is the smallest of its component; rows without a doc_id stay."""
    found = simhash_components(docs, words, radius)
    dropped = store(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct(), "dropped")
    return join_checked(docs, dropped, F.expr("doc_id = _drop"), "left_anti", 8)
