"""Substring dedup: paragraph MinHash banding, then every repeated run of RUN words.

A paragraph is a line of a text. Paragraphs of at least MIN_WORDS words are sets of five-word shingles
with a MinHash signature of BANDS x ROWS values; the bands are tuned so that a pair with the threshold
similarity shares one with probability RECALL or more (``tuned``). Paragraphs with equal word
sequences are one class and never compared; classes that share a band are candidates, verified by
exact Jaccard, and components of verified links are clusters. The first paragraph of a cluster
(smallest doc_id, then place) stays, the others are removals.

Runs are read over the whole text, across line ends and whatever the length of its lines (``spans``).
A run of RUN words that stood before (smaller doc_id, then place) is removed; runs that overlap or touch
make one span, which is the exact repeat. Words of removed paragraphs count as gone, so what stays of a
run is never a copy that went with its paragraph; nor does a run give way to one it overlaps. Equal runs
have the same least hash of their GRAM-word grams, so only runs whose least hash occurs twice are compared.

Edge cases: null and empty texts and texts of fewer than RUN words are left alone; a paragraph or run
repeated inside one document is a removal too; rows that repeat (same doc_id) are copies at the same place, of which the
one kept is kept in every such row; null doc_id: the row takes no part; other columns are ignored and
pass through ``strip``.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasewise.llm.common import WORD, discard, doc_words, join_checked, list_array, mix, shingles, signed, store, whole_groups
from phasewise.llm.linkage import ends_of, link_components, short_handle, short_key, sketch, verified

WORDS, NUM, DEN, MIN_WORDS = 5, 8, 10, 50
RECALL, MOST_HASHES = 0.999, 80
RUN, GRAM = 50, 20
# Places of one least hash that meet in one task; of more, runs are counted by aggregates.
MEET = 4096
# Rows of the bitmap of documents that may hold a repeat, 64 bits each.
BITMAP = 1 << 18


def tuned(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that reaches ``recall`` at the threshold within ``most`` hashes."""
    for rows in range(16, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("too few hashes for this recall")


BANDS, ROWS = tuned(NUM / DEN)
_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BAND = mix(_SALTS) | np.uint64(1)  # weights of the values of a band, other ones in each


def bands(elements: np.ndarray) -> np.ndarray:
    """Band keys of a set of 64-bit hashes; an odd factor orders such hashes anew, so the least of each order is a MinHash."""
    low = np.full(len(_SALTS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 512):
        low = np.minimum(low, (elements[at : at + 512, None] * _SALTS[None, :]).min(axis=0))
    return mix((low * _BAND).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64))


@lru_cache(maxsize=1)
def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    both = mix(at) | np.uint64(1)
    return both[:n], both[n:]


def _sequence(words: np.ndarray) -> np.ndarray:
    """128 bits of a word sequence: two sums of its words, weighted by place."""
    n = len(words)
    first, second = _weights(1 << 12) if n <= 1 << 12 else _weights.__wrapped__(n)
    one, two = (words * first[:n]).sum(dtype=np.uint64), (words * second[:n]).sum(dtype=np.uint64)
    return signed(mix(np.array([one + np.uint64(n), two], np.uint64)))


def _paragraphs(texts: pa.Array):
    """(row, paragraph number, its word hashes) of the long paragraphs of a column."""
    for row, text in enumerate(texts):
        text = text.as_py()
        if not text:
            continue
        lines = text.split("\n")
        for at, words in doc_words(pa.array(lines, pa.string())):
            if len(words) >= MIN_WORDS:
                yield row, at, words


PARTS = "doc_id bigint, part int, n_words int, n int, hi bigint, lo bigint, keys array<bigint>, sketch binary"


def _parts_task(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        ids = batch.column(0).to_pylist()
        for row, part, words in _paragraphs(batch.column(1)):
            s, (hi, lo) = shingles(words, WORDS), _sequence(words).tolist()
            for column, v in zip(out, (ids[row], part, len(words), len(s), hi, lo, bands(s), sketch(s))):
                column.append(v)
            if len(out[0]) == 1024:
                yield _parts_batch(out)
                out = [[] for _ in range(8)]
        yield _parts_batch(out)


def _parts_batch(out):
    i64, i32 = pa.int64(), pa.int32()
    arrays = [pa.array(c, k) for c, k in zip(out[:6], (i64, i32, i32, i32, i64, i64))]
    return pa.RecordBatch.from_arrays(
        [*arrays, list_array(out[6]), pa.array(out[7], pa.binary())], ["doc_id", "part", "n_words", "n", "hi", "lo", "keys", "sketch"]
    )


def _elements_task(batches):
    for batch in batches:
        h, sets = [], []
        wanted = [{(w["hi"], w["lo"]): w["h"] for w in row} for row in batch.column(1).to_pylist()]
        for row, _, words in _paragraphs(batch.column(0)):
            hi, lo = _sequence(words).tolist()
            if (hi, lo) in wanted[row]:
                h.append(wanted[row][hi, lo])
                sets.append(shingles(words, WORDS))
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), list_array(sets)], ["h", "elements"])


def clusters(docs: DataFrame) -> DataFrame:
    """(doc_id, part, n_words, keep_doc_id, keep_part): the place of every paragraph of a cluster of two or more, and of the one that stays."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts = store(text.mapInArrow(_parts_task, PARTS), "parts")
    first = F.min(F.struct("doc_id", "part")).alias("first")
    classes = parts.groupBy("hi", "lo").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = store(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    nodes = classes.select("id", short_handle("lo").alias("h"), "n", "sketch")
    postings = parts.select(F.explode("keys").alias("key"), "lo").select(short_key("key").alias("key"), short_handle("lo").alias("h"))

    def check(pairs: DataFrame) -> DataFrame:
        ends = ends_of(pairs)
        need = ends.join(classes.select(F.col("id").alias("h"), "hi", "lo", F.col("first.doc_id").alias("doc_id")), "h")
        need = store(need.groupBy("doc_id").agg(F.collect_set(F.struct("h", "hi", "lo")).alias("hs")), "need")
        rows = join_checked(text, need, "doc_id", "inner", 64).select("text", "hs")
        elements = store(rows.mapInArrow(_elements_task, "h bigint, elements array<bigint>").dropDuplicates(["h"]), "elements")
        found = verified(pairs, elements, NUM, DEN)
        discard(ends, need, elements)
        return found

    linked = link_components(postings, nodes, check, NUM, DEN)
    labelled = classes.join(linked, "id", "left")
    labelled = store(labelled.select("hi", "lo", "first", "copies", F.coalesce("component", "id").alias("component")), "labelled")
    discard(classes, linked)
    kept = store(labelled.groupBy("component").agg(F.min("first").alias("keep"), F.sum("copies").alias("size")).where("size > 1"), "kept")
    named = store(labelled.join(kept, "component").select("hi", "lo", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.part").alias("keep_part")), "named")
    discard(labelled, kept)
    return parts.select("doc_id", "part", "n_words", "hi", "lo").join(named, ["hi", "lo"]).select("doc_id", "part", "n_words", "keep_doc_id", "keep_part")


def removals(docs: DataFrame) -> DataFrame:
    """Paragraphs to remove: those of a cluster but the one that stays."""
    return clusters(docs).where("doc_id <> keep_doc_id OR part <> keep_part").distinct()


def _wide(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` items."""
    step, size = np.uint64(0x9E3779B97F4A7C15), 1
    while 2 * size <= n:
        x = mix(x[:-size] * step + x[size:])
        size *= 2
    return mix(x[: len(x) - (n - size)] * step + x[n - size :]) if size < n else x


def _least(words: np.ndarray) -> np.ndarray:
    """Least gram hash of every run of RUN words."""
    x, size, n = _wide(words, GRAM), 1, RUN - GRAM + 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :])


def _runs(texts: pa.Array, gone: list):
    """(row, word hashes, places of the runs without a word of a removed paragraph) of the texts with a run."""
    for row, words in doc_words(texts):
        if len(words) < RUN:
            continue
        places = np.arange(len(words) - RUN + 1)
        if gone[row]:
            lines = [len(w) for _, w in doc_words(pa.array(texts[row].as_py().split("\n"), pa.string()))]
            dead = np.repeat(np.isin(np.arange(len(lines)), gone[row]), lines)
            before = np.concatenate([[0], np.cumsum(dead)])
            places = places[before[RUN:] == before[:-RUN]]
        if len(places):
            yield row, words, places


def _anchors_task(batches):
    """The least hashes of a text and at how many places each stands at least."""
    for batch in batches:
        out: list[list] = [[], [], []]
        ids = batch.column(0).to_pylist()
        for row, words, places in _runs(batch.column(1), batch.column(2).to_pylist()):
            least = _least(words)[places]
            first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(places) != 1)]))
            # a stretch longer than one gram's reach has the gram at two places
            times = -(-np.diff(np.append(first, len(least))) // (RUN - GRAM + 1))
            kinds, which = np.unique(least[first], return_inverse=True)
            out[0].append(signed(kinds))
            out[1].append(np.full(len(kinds), ids[row], np.int64))
            out[2].append(np.bincount(which, times).astype(np.int64))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["least", "doc_id", "times"])


def _windows_task(batches):
    """Stretches of runs with one repeated least hash: a hash of every run."""
    for batch in batches:
        ids, wanted, hot = batch.column(0).to_pylist(), batch.column(3), batch.column(4)
        for row, words, places in _runs(batch.column(1), batch.column(2).to_pylist()):
            least = signed(_least(words))[places]
            some = np.isin(least, wanted[row].values.to_numpy())
            places, least = places[some], least[some]
            lo = _wide(words, RUN)[places]
            if not len(lo):
                continue
            fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(places) != 1)])
            fresh[::1024] = True
            for a in range(0, len(lo), 65536):
                at = np.flatnonzero(fresh[a : a + 65536]) + a
                of = least[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(of), pa.array(np.isin(of, hot[row].values.to_numpy())), pa.array(np.full(len(at), ids[row], np.int64)),
                        pa.array(places[at].astype(np.int32)), list_array(np.split(lo[a : a + 65536], at[1:] - a)),
                    ],
                    ["least", "hot", "doc_id", "at", "lo"],
                )


LATER = "doc_id bigint, at int, n int, keep_doc_id bigint, keep_word int"


def _later_task(batches):
    """Runs that stood before and their first places, consecutive ones as one row; stretches come sorted by hash and place."""
    for table in whole_groups(batches, ["least"], 4096):
        runs = table.column("lo").chunk(0)
        lens, lo = runs.value_lengths().to_numpy(), runs.flatten().to_numpy()
        inside = np.arange(len(lo)) - np.repeat(np.cumsum(lens) - lens, lens)
        least, doc, at = (np.repeat(table.column(c).to_numpy(), lens) for c in ("least", "doc_id", "at"))
        at = at + inside
        order = np.lexsort((lo, least))  # stable: the first of equal runs is the first place
        same = (least[order][1:] == least[order][:-1]) & (lo[order][1:] == lo[order][:-1])
        head = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
        first = np.empty_like(order)
        first[order] = order[head]
        later = np.flatnonzero((doc != doc[first]) | (at - at[first] >= RUN))
        if not len(later):
            continue
        doc, at, keep_doc, keep = doc[later], at[later], doc[first[later]], at[first[later]]
        on = (np.diff(doc) == 0) & (np.diff(at) == 1) & (np.diff(keep_doc) == 0) & (np.diff(keep) == 1)
        fresh = np.flatnonzero(np.concatenate([[True], ~on]))
        n = np.diff(np.append(fresh, len(doc)))
        i32 = pa.int32()
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[fresh]), pa.array(at[fresh], i32), pa.array(n, i32), pa.array(keep_doc[fresh]), pa.array(keep[fresh], i32)],
            ["doc_id", "at", "n", "keep_doc_id", "keep_word"],
        )


def spans(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words, keep_doc_id, keep_word): spans to remove beside the paragraphs ``lines``, with the first place of a span's first run."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    gone = store(lines.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("part").alias("gone")), "gone")
    masked = lambda t: join_checked(t, gone, F.expr("doc_id = _id"), "left", 64).select("doc_id", "text", "gone")
    anchors = store(masked(text).mapInArrow(_anchors_task, "least bigint, doc_id bigint, times bigint"), "anchors")
    twice = store(anchors.groupBy("least").agg(F.sum("times").alias("n")).where("n > 1"), "twice")
    need = join_checked(anchors.select("least", "doc_id"), twice, "least", "inner", 16)
    hot = F.collect_set(F.when(F.col("n") > MEET, F.col("least"))).alias("hot")
    need = store(need.groupBy("doc_id").agg(F.collect_set("least").alias("wanted"), hot), "need")
    discard(anchors, twice)
    # texts without a repeated hash are left out before their shuffle, by a bitmap of bounded size
    bit = F.xxhash64("doc_id")
    cell, mask = F.pmod(F.shiftright(bit, 6), F.lit(BITMAP)), F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 AS int))")
    bitmap = need.groupBy(cell.alias("_cell")).agg(F.bit_or(mask).alias("_bits"))
    some = text.join(F.broadcast(bitmap), cell == F.col("_cell")).where(F.col("_bits").bitwiseAND(mask) != 0).select("doc_id", "text")
    windows = join_checked(masked(some), need, "doc_id", "inner", 256).select("doc_id", "text", "gone", "wanted", "hot")
    windows = store(windows.mapInArrow(_windows_task, "least bigint, hot boolean, doc_id bigint, at int, lo array<bigint>"), "windows")
    # equal runs have the same least hash, so they meet where its stretches do
    few = windows.where("NOT hot").select("least", "doc_id", "at", "lo")
    few = few.repartition("least").sortWithinPartitions("least", "doc_id", "at").mapInArrow(_later_task, LATER)
    many = windows.where("hot").select("least", "doc_id", "at", F.posexplode("lo").alias("pos", "lo"))
    many = many.select("least", "lo", "doc_id", (F.col("at") + F.col("pos")).alias("at"))
    first = many.groupBy("least", "lo").agg(F.min(F.struct("doc_id", "at")).alias("keep"))
    first = store(first.select("least", "lo", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.at").alias("keep_word")), "first")
    many = join_checked(many, first, ["least", "lo"], "inner", 40).where(f"doc_id <> keep_doc_id OR at - keep_word >= {RUN}")
    later = few.unionByName(many.select("doc_id", "at", F.lit(1).alias("n"), "keep_doc_id", "keep_word"))
    order = Window.partitionBy("doc_id").orderBy("at", "keep_doc_id", "keep_word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.col("at") + F.col("n") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = later.withColumn("fresh", F.coalesce((F.col("at") - reach > RUN).cast("int"), F.lit(1)))
    numbered = numbered.withColumn("span", F.sum("fresh").over(order))
    found = numbered.groupBy("doc_id", "span").agg(F.min(F.struct("at", "keep_doc_id", "keep_word")).alias("f"), F.max(F.col("at") + F.col("n") - 1).alias("last"))
    return found.select(
        "doc_id", F.col("f.at").alias("first_word"), (F.col("last") - F.col("f.at") + RUN).alias("n_words"),
        F.col("f.keep_doc_id").alias("keep_doc_id"), F.col("f.keep_word").alias("keep_word"),
    )


def repeats(docs: DataFrame) -> DataFrame:
    """All removals: paragraphs (``part``, ``keep_part``) and spans over the whole text (``first_word``, ``keep_word``)."""
    lines = store(removals(docs), "lines")
    none = F.lit(None).cast("int")
    one = lines.select("doc_id", "part", none.alias("first_word"), "n_words", "keep_doc_id", "keep_part", none.alias("keep_word"))
    two = spans(docs, lines).select("doc_id", none.alias("part"), "first_word", "n_words", "keep_doc_id", none.alias("keep_part"), "keep_word")
    return one.unionByName(two)


def _cut(text: str | None, parts: list | None, cuts: list | None) -> str | None:
    """A text without the lines ``parts`` and the word spans ``cuts``."""
    if text is None or not (parts or cuts):
        return text
    gone, cuts = set(parts or ()), sorted((c[0], c[1]) for c in cuts or ())
    places = [m.span() for m in re.finditer(WORD, text)] if cuts else []
    holes = [(places[a][0], places[a + n - 1][1]) for a, n in cuts if a + n <= len(places)]
    out, start, hole = [], 0, 0
    for part, line in enumerate(text.split("\n")):
        end = start + len(line)
        while hole < len(holes) and holes[hole][1] <= start:
            hole += 1
        kept, at, k = [], start, hole
        while k < len(holes) and holes[k][0] < end:
            kept.append(text[at : max(at, holes[k][0])])
            at = max(at, min(end, holes[k][1]))
            k += 1
        touched = k > hole
        kept = "".join(kept) + text[at:end]
        if part not in gone and not (touched and not kept.strip()):
            out.append(kept)
        start = end + 1
    return "\n".join(out)


def strip(docs: DataFrame) -> DataFrame:
    """``docs`` with the removals cut from their texts."""
    found = store(repeats(docs), "repeats")
    gone = found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set("part").alias("_parts"), F.collect_list(F.when(F.col("first_word").isNotNull(), F.struct("first_word", "n_words"))).alias("_cuts")
    )
    joined = join_checked(docs, store(gone, "gone"), F.expr("doc_id = _id"), "left", 64)
    kept = F.udf(_cut, "string")(F.col("text").cast("string"), "_parts", "_cuts")
    return joined.select(*[F.when(F.col("_id").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns])
