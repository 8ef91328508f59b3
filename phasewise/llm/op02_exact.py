"""Exact dedup over an extendible-hash index kept as shared files. DataFrame functions only.

The key of a text is the head of the SHA-256 of its normalised bytes. A directory maps key prefixes
to buckets: distinct keys are counted once at a deep prefix, and from one bucket on every bucket that holds more
keys than it may is split by one more bit; sparse ones keep a shorter prefix. Every text is routed to its bucket, the
range of keys of an owner. There texts with one key chain up and their bytes are compared, because the text itself
is part of the grouping; a link keeps the count of its copies and the row that stays. Copies are
counted where they are read, before the shuffle, so a text that fills a third of the table reaches its owner
as one row per reading task. The index files are sorted by bucket and key. Rows look their link up by bucket and
key and follow the chain by digest: without the directory a row finds nothing.

Edge cases: null text counts as empty; empty texts are copies of each other; texts of any length are compared whole; of equal
texts the one with most code points in the original, then the smallest doc_id, stays (a null doc_id loses to any
other); repeated rows with the kept doc_id are all flagged kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasewise.llm.common import discard, shared_path, store

# Chain links a bucket may hold before it splits, and the bits a directory may use.
BUCKET_LINKS = 200_000
MAX_DEPTH = 30
KEY_BITS = 60
# A longer original wins, then a smaller id: both in one decimal, which hash aggregates can hold.
SPAN = "cast(18446744073709551616 as decimal(38,0))"
HALF = "cast(9223372036854775807 as decimal(38,0))"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - depth)


def directory(keys: DataFrame, bucket_links: int = BUCKET_LINKS) -> list[tuple[int, int]]:
    """Buckets as (depth, prefix) in key order, for the distinct ``key`` values.

    One count at a prefix a few bits deeper than evenly filled buckets need; the driver sees about 16 cells a bucket.
    """
    total = keys.count()
    deep = min(MAX_DEPTH, max(0, total // max(1, bucket_links)).bit_length() + 4)
    cells = {r.p: r.n for r in keys.groupBy(prefix(F.col("key"), deep).alias("p")).agg(F.count("*").alias("n")).collect()}
    levels = [cells]  # deepest first; each level folds two cells into one
    for _ in range(deep):
        up: dict[int, int] = {}
        for p, n in levels[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        levels.append(up)
    done, left = [], [(0, 0)]
    while left:
        depth, p = left.pop()
        if levels[deep - depth].get(p, 0) > bucket_links and depth < deep:
            left += [(depth + 1, 2 * p), (depth + 1, 2 * p + 1)]
        else:
            done.append((depth, p))
    return sorted(done, key=lambda b: b[1] << (MAX_DEPTH - b[0]))


def bucket_of(key: Column, buckets: list[tuple[int, int]]) -> Column:
    """Number of the bucket: position of the key among the starts of the ranges (binary search, native)."""
    starts = [p << (KEY_BITS - d) for d, p in buckets]
    steps = [1 << i for i in reversed(range(len(starts).bit_length()))]
    table = F.expr(f"cast(split('{','.join(map(str, starts))}', ',') as array<bigint>)")
    step = lambda at, s: F.when((at + s <= len(starts)) & (F.get(table, at + s - 1) <= key), at + s).otherwise(at)
    return F.aggregate(F.expr(f"array({','.join(map(str, steps))})"), F.lit(0), step) - 1


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, norm, chars, sha, key) of every row of ``docs`` (doc_id, text)."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), normalised(text).alias("norm"), F.coalesce(F.length(text), F.lit(0)).alias("chars")
    ).withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    return rows.withColumn("key", F.conv(F.substring(F.hex("sha"), 1, KEY_BITS // 4), 16, 10).cast("bigint"))


def build_index(texts: DataFrame, buckets: list[tuple[int, int]]) -> DataFrame:
    """Index files: one row for each distinct text (bucket, key, chain, sha, keep_id, group_size), owners by bucket.

    ``chain`` is the place among the texts of one key, which differ in their bytes.
    """
    best = F.expr(
        f"cast(chars as decimal(38,0)) * {SPAN} + coalesce({HALF} - cast(doc_id as decimal(38,0)), cast(-1 as decimal(38,0)))"
    )
    routed = texts.withColumns({"best": best, "bucket": bucket_of(F.col("key"), buckets)})
    links = routed.groupBy("bucket", "key", "sha", "norm").agg(F.max("best").alias("best"), F.count("*").alias("group_size"))
    rank = F.expr(f"best % {SPAN}")
    keep = F.when(rank <= F.expr(f"{SPAN} - 2"), F.expr(f"cast({HALF} - best % {SPAN} as bigint)"))
    owned = links.select("bucket", "key", "sha", keep.alias("keep_id"), "group_size").repartition("bucket")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha"))
    owned = owned.withColumn("chain", chain).sortWithinPartitions("bucket", "key", "chain")
    path = shared_path(texts.sparkSession, "index")
    owned.write.parquet(path)
    return texts.sparkSession.read.schema(owned.schema).parquet(path)


def look_up(texts: DataFrame, index: DataFrame, buckets: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): every row's link, by bucket and key, then along the chain by digest."""
    rows = texts.select("doc_id", "sha", "key", bucket_of(F.col("key"), buckets).alias("bucket"))
    found = rows.join(index.drop("chain"), ["bucket", "key", "sha"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.equal_null("doc_id", "keep_id").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def exact_groups(docs: DataFrame, bucket_links: int = BUCKET_LINKS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text)."""
    texts = keyed_texts(docs)
    keys = store(texts.select("key").distinct(), "keys")
    buckets = directory(keys, bucket_links)
    discard(keys)
    return look_up(texts, build_index(texts, buckets), buckets)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that lose to an equal text; repeated kept rows are left as they are."""
    found = exact_groups(docs).where("NOT kept").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(found, F.expr("doc_id <=> _drop"), "left_anti")
