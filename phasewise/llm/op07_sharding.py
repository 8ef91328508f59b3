"""Sharding by sampled splitters, law ``bytes``. DataFrame functions only.

Rows are ordered by a 63-bit key: CRC-32 of the text, then a hash of the id, so equal texts are
neighbours and a text that fills a third of the table still spreads. A sample drawn with probability
in proportion to size gives splitters whose ranges hold about equal bytes; exact bytes per range are
summed over all rows, and ranges that came out overfull are sampled again and subdivided. Inside a
range a window gives each row its bytes before it; with the offsets of the ranges that is its exact
place in the whole order, and shard boundaries are the exact quantiles of bytes. A group of equal
texts up to GROUP_SHARE of a shard is not cut by a boundary (its middle decides); a larger one is.

Edge cases: size is the UTF-8 length plus 16, 16 for null; ``text_crc32`` of a null text is that of the
empty one; rows equal in id and text are placed in any order among themselves, which changes no value;
fewer rows than shards leave shards empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasewise.functions import keyed
from phasewise.llm.common import store

SHARDS = 40
OVERHEAD = 16
# Keys drawn for each range, rows a range should hold, and most ranges (the bound of what is broadcast).
DRAWS, RANGE_ROWS, MAX_RANGES = 16, 250_000, 16_384
GROUP_SHARE = 50


def _position(key, values: list[int]):
    """How many of the sorted ``values`` are at most ``key``: binary search in a literal array."""
    table = F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)") if values else F.expr("cast(array() as array<bigint>)")
    steps = [1 << i for i in reversed(range(max(1, len(values).bit_length())))]
    step = lambda at, s: F.when((at + s <= len(values)) & (F.get(table, at + s - 1) <= key), at + s).otherwise(at)
    return F.aggregate(F.expr(f"array({','.join(map(str, steps))})"), F.lit(0), step)


def _draw(rows: DataFrame, total: int, wanted: int, round_: int) -> list[int]:
    """Keys drawn in proportion to size; about ``wanted`` of them."""
    u = keyed.uniform(round_, "split", F.col("key"), F.col("doc_id"))
    picked = rows.where(u * total < F.col("size") * float(wanted)).select("key")
    return sorted(r.key for r in picked.collect())


def _splitters(rows: DataFrame, count: int, total: int) -> list[int]:
    """Size-weighted quantile splitters; overfull ranges are drawn again and subdivided."""
    ranges = max(1, min(MAX_RANGES // 4, max(8 * SHARDS, -(-count // RANGE_ROWS))))
    sample = _draw(rows, total, DRAWS * ranges, 1)
    splitters = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    for again in range(2, 6):
        loads = rows.groupBy(_position(F.col("key"), splitters).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        over = [r for r in loads.collect() if r.b * ranges > 2 * total and r.n > 64 and r.lo < r.hi]
        if not over:
            break
        spans = [r.r for r in over]
        inside = rows.withColumn("r", _position(F.col("key"), splitters)).where(F.col("r").isin(spans))
        wanted = sum(-(-DRAWS * ranges * r.b // total) for r in over)
        more = _draw(inside, sum(r.b for r in over), wanted, again)
        splitters = sorted({*splitters, *more[DRAWS // 2 :: DRAWS]})[: MAX_RANGES - 1]
    return splitters


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    spread = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)
    rows = store(rows.withColumn("key", F.shiftleft("text_crc32", 31).bitwiseOR(spread)), "keys")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # a splitter falls on the start of a text, unless the text holds several: then inside it
    drawn, splitters = _splitters(rows, count, total), []
    for a, b in zip([None, *drawn[:-1]], drawn):
        splitters.append(b if a is not None and a >> 31 == b >> 31 else b >> 31 << 31)
    splitters = sorted(set(splitters))
    ranged = rows.withColumn("r", _position(F.col("key"), splitters))
    ranges = sorted(ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())
    start, at, first = {}, 0, 0
    for r in ranges:
        start[r.r] = (at, first)
        at, first = at + r.b, first + r.n
    lookup = lambda i: F.get(
        F.expr("cast(split('" + ",".join(str(start.get(r, (0, 0))[i]) for r in range(len(splitters) + 1)) + "', ',') as array<bigint>)"), F.col("r")
    )
    here = Window.partitionBy("r").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("r").orderBy("key", "doc_id")
    group = Window.partitionBy("r", "text_crc32")
    placed = ranged.select(
        "doc_id", "size", "text_crc32", "key", "r",
        (lookup(0) + F.coalesce(F.sum("size").over(here), F.lit(0))).alias("before"),
        (lookup(1) + F.row_number().over(order) - 1).alias("rank"),
    )
    placed = placed.withColumn("gsize", F.sum("size").over(group)).withColumn("gstart", F.min("before").over(group))
    whole = F.col("gsize") * GROUP_SHARE * shards <= total
    middle = F.when(whole, 2 * F.col("gstart") + F.col("gsize")).otherwise(2 * F.col("before") + F.col("size"))
    number = F.expr(f"cast(least({shards - 1}, (cast(middle as decimal(38,0)) * {shards}) div {max(1, 2 * total)}) as int)")
    placed = store(placed.withColumn("middle", middle).withColumn("shard", number).select("doc_id", "size", "text_crc32", "shard", "rank"), "placed")
    firsts = store(placed.groupBy("shard").agg(F.min("rank").alias("first")), "firsts")  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write ``docs`` as one folder for each shard and return the placement; a hot id is split by AQE."""
    found = shard(docs, shards)
    target = found.select(F.col("doc_id").alias("_id"), F.col("shard").alias("shard_number")).distinct()
    docs.join(target, F.expr("doc_id <=> _id")).drop("_id").write.partitionBy("shard_number").parquet(path)
    return found
