"""Exact links between sets that share candidate lists, without all pairs of a list leaving a task.

Sets are known by a number of their own, ``id``; the candidate lists ``postings`` (key, h) name them by 40 bits,
``h``, since that is most of what is shuffled: sets that share an h simply stand in each other's lists. Two sets that
link share a key. A list only ever meets its own members; what leaves a task is, for each component found
so far, its few closest untested partners. Verified links contract components, and the next round
goes on with more partners until no list has held one back, so no link between components is lost.

The closeness bound is exact: a parity sketch flips one bit for each differing element, so the
Hamming distance of two sketches never exceeds the size of the symmetric difference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.llm.common import components, discard, join_checked, store, tidy

# Members of a list that are compared in one task; longer lists are split into pairs of tiles.
TILE = 4096
# Partners per component and list in the first round, and the growth per round.
FIRST, GROWTH = 4, 16


def sketch(elements: np.ndarray) -> bytes:
    """Parity bits of a set of 64-bit hashes; at least one bit for an element, a power of two."""
    bits = 256
    while bits < len(elements):
        bits *= 2
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(raw: bytes, bits: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint64)
    while len(x) * 64 > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def most_different(total, num: int, den: int):
    """Largest symmetric difference of two sets of ``total`` elements together with Jaccard >= num/den."""
    return total * (den - num) // (den + num)


def _pairs(n, comp, rows, num, den, most, tile):
    """Indices of the closest pairs of different components that may link; whether some were held back."""
    bits = min(len(r) for r in rows) * 8
    x = np.stack([_fold(r, bits) for r in rows])
    left, right, far = [], [], []
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        ok = (comp[j] != comp[i]) & (den * np.minimum(n[j], n[i]) >= num * np.maximum(n[j], n[i]))
        if tile is not None:
            ok &= tile[j] != tile[i]
        j = j[ok]
        if not len(j):
            continue
        apart = np.bitwise_count(x[j] ^ x[i]).sum(axis=1, dtype=np.int64)
        near = apart <= most_different(n[j] + n[i], num, den)
        j = j[near]
        if len(j):
            left.append(np.full(len(j), i))
            right.append(j)
            far.append(apart[near])
    if not left:
        return None
    left, right, far = np.concatenate(left), np.concatenate(right), np.concatenate(far)
    order = np.argsort(far, kind="stable")
    left, right = left[order], right[order]
    ends = np.empty(2 * len(left), comp.dtype)
    ends[0::2], ends[1::2] = comp[left], comp[right]
    by = np.argsort(ends, kind="stable")
    fresh = np.concatenate([[True], ends[by][1:] != ends[by][:-1]])
    at = np.arange(len(by))
    rank = np.empty(len(by), np.int64)
    rank[by] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    keep = (rank[0::2] < most) | (rank[1::2] < most)
    return left[keep], right[keep], not keep.all()


def _list_task(num: int, den: int, most: int):
    def run(batches):
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table):
            key = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [key.shape[1]]])
            h, n, comp = (table.column(c).to_numpy() for c in ("h", "n", "comp"))
            t = table.column("t").to_numpy()
            rows = table.column("sketch").to_pylist()
            a, b, held_back = [], [], []
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s < 2 or (comp[s:e] == comp[s]).all():
                    continue
                # a pair of tiles leaves pairs inside one tile to the pair (i, i)
                tile = t[s:e] if key[1, s] != key[2, s] else None
                found = _pairs(n[s:e], comp[s:e], rows[s:e], num, den, most, tile)
                if found is not None:
                    a.append(h[s:e][found[0]])
                    b.append(h[s:e][found[1]])
                    if found[2]:
                        held_back.append(key[:, s])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                pairs, lists = len(a), len(held_back)
                none = pa.nulls(pairs, pa.int64())
                at = [pa.concat_arrays([none, pa.array(k)]) for k in np.array(held_back, np.int64).reshape(lists, 3).T]
                ends = [pa.concat_arrays([pa.array(x), pa.nulls(lists, pa.int64())]) for x in (np.minimum(a, b), np.maximum(a, b))]
                yield pa.RecordBatch.from_arrays([*ends, *at], ["a", "b", "key", "i", "j"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = [table.column(c)[-1].as_py() for c in ("key", "i", "j")]
            same = np.ones(table.num_rows, bool)
            for c, v in zip(("key", "i", "j"), last):
                same &= table.column(c).to_numpy() == v
            done = int(np.argmax(same))  # rows of the last list may go on in the next batch
            if done:
                yield from work(table.slice(0, done))
                held = table.slice(done).combine_chunks().to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def short_key(column) -> Column:
    """48 bits of a posting key: fewer bytes to shuffle, and keys that fall together only lengthen a list."""
    return F.shiftrightunsigned(column, 16)


def short_handle(column) -> Column:
    return F.shiftrightunsigned(column, 24)


# Bytes of a packed key and handle, postings packed at a time, and buckets for each shuffle partition.
KEY_BYTES, H_BYTES, CHUNK, BUCKETS = 6, 5, 1 << 20, 8
LISTS = "key bigint, a bigint, b bigint, c bigint, s bigint, x bigint"
PACKED = "bucket int, key binary, h binary, lists binary"


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low bytes of each number, one byte plane after the other: planes of sorted numbers compress."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<i8")


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (key, a, b, c, s, x) with one row left for each key, sorted by it."""
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    at = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
    by = (np.minimum, np.maximum, np.add, np.add, np.bitwise_xor)
    return np.stack([rows[0, at], *[f.reduceat(r, at) for f, r in zip(by, rows[1:])]])


def _pack_task(buckets: int):
    """Postings (key, h) to packed pieces, one for each bucket of keys; keys met twice become a row of a list."""

    def pieces(batches):
        table = pa.Table.from_batches(batches)
        key, h = (table.column(c).to_numpy() for c in ("key", "h"))
        order = np.argsort(key, kind="stable")
        key, h = key[order], h[order]
        new = np.concatenate([[True], key[1:] != key[:-1], [True]])
        lone = new[1:] & new[:-1]
        twice = h[~lone]
        many = np.stack([key[~lone], twice, twice, np.ones(len(twice), np.int64), twice, twice])
        many = _summed(many) if many.shape[1] else many
        key, h = key[lone], h[lone]
        bucket, of_many = (((k.view(np.uint64) >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32) for k in (key, np.ascontiguousarray(many[0])))
        kinds = np.union1d(bucket, of_many)
        lo, hi, lo2, hi2 = (np.searchsorted(b, kinds, side) for b in (bucket, of_many) for side in ("left", "right"))
        out = [
            pa.array(kinds.astype(np.int32)),
            pa.array([_pack(key[a:b], KEY_BYTES) for a, b in zip(lo, hi)], pa.binary()),
            pa.array([_pack(h[a:b], H_BYTES) for a, b in zip(lo, hi)], pa.binary()),
            pa.array([many[:, a:b].tobytes() for a, b in zip(lo2, hi2)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(out, ["bucket", "key", "h", "lists"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield pieces(held)
                held, rows = [], 0
        if rows:
            yield pieces(held)

    return run


def _lists_task(batches):
    """The lists of whole buckets with two members or more."""

    def work(parts):
        rows = []
        for key, h, lists in parts:
            key, h = _unpack(key, KEY_BYTES), _unpack(h, H_BYTES)
            rows += [np.stack([key, h, h, np.ones(len(h), np.int64), h, h]), np.frombuffer(lists, np.int64).reshape(6, -1)]
        found = _summed(np.concatenate(rows, axis=1))
        found = found[:, found[1] < found[2]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["key", "a", "b", "c", "s", "x"])

    now, parts = None, []
    for batch in batches:
        for bucket, *part in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and parts:
                yield work(parts)
                parts = []
            now = bucket
            parts.append(part)
    if parts:
        yield work(parts)


def shared_lists(postings: DataFrame) -> DataFrame:
    """(key, a, b, c, s, x) of the keys that different h post: least, largest, number, sum and exclusive or of their h.

    Nearly all keys are posted once. Postings travel packed, so a posting takes its few bytes however many partitions there are,
    and a key that many sets post is summed up before it travels.
    """
    buckets = BUCKETS * int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = postings.select("key", "h").mapInArrow(tidy(_pack_task(buckets)), PACKED)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_lists_task), LISTS)


def link_components(postings: DataFrame, nodes: DataFrame, check, num: int, den: int) -> DataFrame:
    """(id, component) over ids that have a link; ids without one are absent.

    ``postings`` (key, h), ``nodes`` (id, h, n, sketch) stored with one row for each set; ``check(pairs)`` stores the (a, b) rows of
    the stored table ``pairs`` that link by the exact sets.
    """
    # lists of the same members say the same: one of them is enough (sum and exclusive or tell members apart)
    lists = store(shared_lists(postings).groupBy("a", "b", "c", "s", "x").agg(F.min("key").alias("key")), "lists")
    two = lists.where("c = 2").select(F.col("a").alias("ha"), F.col("b").alias("hb")).distinct()
    twins = nodes.groupBy("h").count().where("count > 1").select(F.col("h").alias("ha"), F.col("h").alias("hb"))
    two = store(_possible(two.unionByName(twins), nodes, num, den), "pairs")
    keys = store(lists.where("c > 2").select("key", F.ceil(F.col("c") / TILE).cast("int").alias("tiles")), "keys")
    member = join_checked(postings, keys, "key", "inner", 12).distinct().join(nodes.select("h", "id", "n", "sketch"), "h")
    member = member.drop("h").withColumnRenamed("id", "h").withColumn("t", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int"))
    member = member.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    member = store(member.select("key", "h", "n", "sketch", "t", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j")), "members")
    discard(lists, keys)

    links = check(two)
    discard(two)
    most = FIRST
    comp = components(links)
    spent = []
    unfinished = member
    while True:
        labelled = unfinished.join(comp.select(F.col("id").alias("h"), "component"), "h", "left")
        labelled = labelled.withColumn("comp", F.coalesce("component", "h")).drop("component")
        found = store(
            labelled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(tidy(_list_task(num, den, most)), "a bigint, b bigint, key bigint, i bigint, j bigint"),
            "found",
        )
        discard(*spent)
        spent = [found]
        if found.isEmpty():
            break
        pairs = store(found.where("a IS NOT NULL").select("a", "b").distinct(), "pairs")
        more = check(pairs)
        last, links = links, store(links.unionByName(more).distinct(), "links")
        discard(pairs, more, last, comp)
        comp = components(links)
        # a list that held nothing back has had all its pairs of different components tested
        held_back = store(found.where("key IS NOT NULL").select("key", "i", "j"), "heldback")
        spent.append(held_back)
        if held_back.isEmpty():
            break
        unfinished = join_checked(member, held_back, ["key", "i", "j"], "left_semi", 24)
        most *= GROWTH
    discard(member, links, *spent)
    return comp


def _possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of ids of the handles (ha, hb), without those that the sizes or the sketches exclude."""
    side = lambda x: nodes.select(F.col("h").alias(f"h{x}"), F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "ha").join(side("b"), "hb").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb")).where("ha < hb OR a < b")

    def near(batches):
        for batch in batches:
            t = batch.to_pydict()
            keep = []
            for na, nb, sa, sb in zip(t["na"], t["nb"], t["sa"], t["sb"]):
                bits = min(len(sa), len(sb)) * 8
                keep.append(int(np.bitwise_count(_fold(sa, bits) ^ _fold(sb, bits)).sum()) <= most_different(na + nb, num, den))
            chosen = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            ends = np.sort(np.stack([chosen.column(0).to_numpy(), chosen.column(1).to_numpy()]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], ["a", "b"])

    return both.mapInArrow(tidy(near), "a bigint, b bigint")


def verified(pairs: DataFrame, elements: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``pairs`` whose exact sets, ``elements`` (h, elements), reach the similarity; stored."""
    one, two = (elements.select(F.col("h").alias(end), F.col("elements").alias(f"e{end}")) for end in ("a", "b"))
    union = F.size("ea") + F.size("eb") - F.col("shared")
    both = pairs.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("ea", "eb")))
    return store(both.where(den * F.col("shared") >= num * union).select("a", "b").distinct(), "verified")


def ends_of(pairs: DataFrame) -> DataFrame:
    """(h): the ids that occur in ``pairs``; stored."""
    return store(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct(), "ends")
