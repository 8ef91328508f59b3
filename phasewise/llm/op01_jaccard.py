"""N-gram Jaccard join: size-aware heavy-light join over the distinct word shingles of documents.

Light (small) sets enumerate their fixed-size subsets: two sets with Jaccard >= t share a subset of
the size of their overlap, so equal subsets are the candidates. Heavy sets post their shingles to
inverted lists and scan them. The boundary is where enumerating subsets costs more bytes than posting
and checking. Lists of single shingles would put every document that quotes a common passage into
one list, so a list entry is a run of shingles: the hash range is cut into more parts than two linking
sets can differ in, hence they agree on at least one whole part, and a list holds the sets that do.

Equal sets are one class and join once. Result rows and edge cases:

* null or empty text, or no word: ``n_shingles`` 0, linked with nothing, own component;
* fewer words than a shingle: the whole sequence is the only shingle;
* rows that share a doc_id are one vertex; repeated rows repeat in the result;
* null doc_id: the row stays, has no component (null) and takes no part;
* other columns of ``docs`` are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.llm.common import components, discard, doc_words, join_checked, list_array, mix, shingles, signed, store, tidy
from phasewise.llm.linkage import ends_of, link_components, most_different, short_handle, short_key, sketch, verified

RATIO = 1.4  # sizes of one class of heavy sets, largest to smallest
ENTRY = 16  # bytes of a posting


class Plan:
    """Size classes, parts per class and the boundary between light and heavy for a threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.light = 1
        while self._subsets(self.light) * ENTRY <= self._heavy_bytes(self.light):
            self.light += 1
        self.first_heavy = -(-num * self.light // den)  # partners of heavy sets post as well

    def _subsets(self, s: int) -> int:
        return sum(comb(s, k) for k in range(s - -(-self.num * s // self.den) + 1))

    def _heavy_bytes(self, s: int) -> int:
        return ENTRY * sum(self.parts(c)[0] for c in self.classes(s)) + 8 * s

    def upper(self, c: int) -> int:
        return int(8 * RATIO**c)

    def class_of(self, s: int) -> int:
        c = max(0, int(np.log(max(s, 1) / 8) / np.log(RATIO)) - 1)
        while self.upper(c) < s:
            c += 1
        return c

    def classes(self, s: int) -> range:
        """A set posts to its class and to those of its larger partners."""
        return range(self.class_of(s), self.class_of(s * self.den // self.num) + 1)

    def parts(self, c: int) -> tuple[int, int]:
        """Parts of the hash range, and how many of a set may be empty and need no posting.

        With E empty parts allowed there are E more parts than differences + 1, so two linking sets
        agree on E + 1 parts and on one that holds shingles, unless both have more than E empty ones;
        such sets post their empty parts too.
        """
        size, differ = self.upper(c), most_different(2 * self.upper(c), self.num, self.den)
        spare = 1
        while spare < 1 + 1.5 * (differ + 1 + spare) * exp(-size / RATIO / (differ + 1 + spare)) and spare < differ + 1:
            spare += 1
        return differ + 1 + spare, spare


def keys_of(elements: np.ndarray, plan: Plan) -> np.ndarray:
    """Posting keys of a sorted set of 64-bit hashes."""
    s = len(elements)
    out = []
    content = mix(elements + np.uint64(0x1234567))
    if s < plan.light:
        total = content.sum(dtype=np.uint64)
        for k in range(s - -(-plan.num * s // plan.den) + 1):
            if k == 0:
                sums = np.array([total])
            else:
                gone = np.array(list(combinations(range(s), k)))
                sums = total - content[gone].sum(axis=1, dtype=np.uint64)
            out.append(mix(sums + np.uint64(s - k)))
    if s >= plan.first_heavy:
        high = elements >> np.uint64(32)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(content, dtype=np.uint64)])
        for c in plan.classes(s):
            m, spare = plan.parts(c)
            part = (high * np.uint64(m)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(m + 1, dtype=np.uint64))
            sums = running[cuts[1:]] - running[cuts[:-1]]
            full = cuts[1:] > cuts[:-1]
            keys = mix(mix(sums) + np.arange(m, dtype=np.uint64) + np.uint64((c + 1) << 32))
            out.append(keys[full] if m - int(full.sum()) <= spare else keys)
    return np.concatenate(out) if out else elements[:0]


def _signature(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, order-free."""
    lo = mix(elements).sum(dtype=np.uint64)
    hi = mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    both = signed(mix(np.array([lo + np.uint64(len(elements)), hi], np.uint64)))
    return int(both[1]), int(both[0])


SETS = "doc_id bigint, n bigint, hi bigint, lo bigint, keys array<bigint>, sketch binary"


def _sets_task(words: int, num: int, den: int):
    def run(batches):
        plan = Plan(num, den)
        for batch in batches:
            n, hi, lo, keys, bits = [], [], [], [], []
            for _, w in doc_words(batch.column(1)):
                s = shingles(w, words)
                n.append(len(s))
                h, l = _signature(s)
                hi.append(h)
                lo.append(l)
                keys.append(keys_of(s, plan) if len(s) else s)
                bits.append(sketch(s) if len(s) else None)
                if len(n) == 1024:
                    yield _sets_batch(batch.column(0).slice(0, 1024), n, hi, lo, keys, bits)
                    batch = batch.slice(1024)
                    n, hi, lo, keys, bits = [], [], [], [], []
            yield _sets_batch(batch.column(0), n, hi, lo, keys, bits)

    return run


def _sets_batch(ids, n, hi, lo, keys, bits):
    kind = pa.int64()
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, kind), pa.array(hi, kind), pa.array(lo, kind), list_array(keys), pa.array(bits, pa.binary())],
        ["doc_id", "n", "hi", "lo", "keys", "sketch"],
    )


def _elements_task(words: int):
    def run(batches):
        for batch in batches:
            wanted, ids = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())), batch.column(4).to_pylist()
            h, sets = [], []
            for row, w in doc_words(batch.column(1)):
                s = shingles(w, words)
                if _signature(s) == wanted[row]:
                    h.append(ids[row])
                    sets.append(s)
                if len(h) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), list_array(sets)], ["h", "elements"])
                    h, sets = [], []
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), list_array(sets)], ["h", "elements"])

    return run


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = store(text.mapInArrow(tidy(_sets_task(words, num, den)), SETS), "sets")
    used = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = used.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = store(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    nodes = classes.select("id", short_handle("lo").alias("h"), "n", "sketch")
    postings = used.select(F.explode("keys").alias("key"), "lo").select(short_key("key").alias("key"), short_handle("lo").alias("h"))

    def check(pairs: DataFrame) -> DataFrame:
        ends = ends_of(pairs)
        need = store(ends.join(classes.select(F.col("id").alias("h"), "hi", "lo", F.col("rep").alias("doc_id")), "h"), "need")
        rows = join_checked(text, need, "doc_id", "inner", 40).select("doc_id", "text", "hi", "lo", "h")
        elements = store(rows.mapInArrow(tidy(_elements_task(words)), "h bigint, elements array<bigint>"), "elements")
        found = verified(pairs, elements, num, den)
        discard(ends, need, elements)
        return found

    linked = link_components(postings, nodes, check, num, den)
    # a component of ids becomes the smallest doc_id of its classes
    labelled = classes.select("hi", "lo", "rep", "id").join(linked, "id", "left")
    labelled = store(labelled.withColumn("component", F.coalesce("component", "id")), "labelled")
    least = store(labelled.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = store(labelled.join(least, "component").select("hi", "lo", "component_id"), "named")
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    rows = sets.select("doc_id", "n", F.when(F.expr("n > 0 AND doc_id IS NOT NULL"), F.col("hi")).alias("hi"), "lo")
    out = rows.join(named, ["hi", "lo"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", alone).alias("component_id")
    )
    # a doc_id with several texts joins their components
    out = store(out, "rows")
    discard(sets, classes, linked, labelled, least, named)
    split = store(
        out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a < b"), "split"
    )
    if split.isEmpty():
        return out
    every = out.join(split.select("doc_id", "a"), "doc_id").select("a", F.col("component_id").alias("b"))
    merged = components(every.where("a <> b")).select(F.col("id").alias("component_id"), "component")
    return out.join(merged, "component_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id")
    )


def keep_one(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id. Rows without a doc_id stay."""
    found = jaccard_components(docs, words, num, den)
    dropped = store(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct(), "dropped")
    repeated = store(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_drop")), "repeated")
    kept = join_checked(docs, dropped, F.expr("doc_id = _drop"), "left_anti", 8)
    if repeated.isEmpty():
        return kept
    again = join_checked(kept, repeated, F.expr("doc_id = _drop"), "left_semi", 8)
    return join_checked(kept, repeated, F.expr("doc_id = _drop"), "left_anti", 8).unionByName(again.dropDuplicates(["doc_id"]))
