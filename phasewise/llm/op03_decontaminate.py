"""Benchmark decontamination by spaced-seed hashing.

Words are compared lower-cased and without ASCII punctuation. Every mask of MASKS picks some of the
words of a short span and ignores the others; hashes of the picked words of all spans of the benchmark
are joined with those of every document. A hit fixes an alignment of document and item, and around it
the words are compared: the document is contaminated if WINDOW aligned words differ in at most
SUBSTITUTED places. The masks find every such window: any two positions of 13 leave one mask whole
(tested). Items of 6 to 12 words must occur whole and unchanged; shorter items name no passage and are
not searched. Substituted words only: an inserted word shifts the alignment, and the windows on either
side of it still match.

The benchmark is the query set. It is read in blocks of at most BLOCK_BYTES of text, and every block
meets every document where it lies, so documents are never shuffled and what a task holds is bounded
whatever the benchmark's size. Items longer than ITEM_WORDS are cut into overlapping pieces; ``n_words`` counts the
words of the whole item that some agreeing window covers, each once.

Edge cases: texts of any length are searched whole; ties do not arise; null or empty texts on either side match nothing; null item ids are reported as null;
repeated documents and repeated items each give their rows; other columns are ignored, and ``clean``
passes them through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.llm.common import PUNCTUATION, doc_words, mix, tidy

# 1 is compared, 0 ignored.
MASKS = ("111111", "1111101", "1101111")
WINDOW, SUBSTITUTED = 13, 2
BLOCK_BYTES = 4 << 20
ITEM_WORDS = 512
# Meetings of seeds looked at in one numpy pass.
HITS = 1 << 20
# Documents lower-cased at a time.
ROWS = 1024


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the picked words for every span of the mask."""
    spans = len(words) - len(mask) + 1
    if spans <= 0:
        return words[:0]
    out = np.full(spans, np.uint64(len(mask)), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = mix(out + words[i : i + spans])
    return out


class Block:
    """Seeds of one block of the benchmark, sorted by hash."""

    def __init__(self, ids: list, texts: list):
        words, owner, starts, self.lengths = [], [], [], {}
        for row, w in doc_words(pc.utf8_lower(pa.array(texts, pa.string())), gaps=PUNCTUATION):
            step = ITEM_WORDS - WINDOW + 1
            self.lengths[row] = len(w)
            for at in range(0, max(1, len(w) - WINDOW + 1), step):
                if len(piece := w[at : at + ITEM_WORDS]) >= len(MASKS[0]):
                    words.append(piece)
                    owner.append(row)
                    starts.append(at)
        self.ids, self.owner, self.starts, self.words = ids, owner, starts, words
        self.tables = []
        for mask in MASKS:
            seeds = [_seeds(w, mask) for w in words]
            flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
            at = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else item
            order = np.argsort(flat, kind="stable")
            self.tables.append((flat[order], item[order], at[order]))

    def _alignments(self, doc: np.ndarray) -> np.ndarray:
        """Distinct (piece, shift) pairs on which a seed of the document meets one of a piece, as piece << 40 | shift + 2^39."""
        found = []
        for mask, (hashes, item, at) in zip(MASKS, self.tables):
            seeds = _seeds(doc, mask)
            if not len(seeds) or not len(hashes):
                continue
            lo = np.searchsorted(hashes, seeds)
            place = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == seeds)
            lo = lo[place]
            many = np.searchsorted(hashes, seeds[place], side="right") - lo
            # a word that repeats on both sides meets itself very often: taken in runs of bounded length
            ends = np.cumsum(many)
            start = 0
            while start < len(place):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HITS, side="right")))
                n = many[start:stop]
                first = np.cumsum(n) - n
                entry = np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(lo[start:stop], n)
                shift = np.repeat(place[start:stop], n) - at[entry]
                found.append(np.unique((item[entry] << 40) + shift + (1 << 39)))
                start = stop
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def _verified(self, doc: np.ndarray, code: int) -> tuple[int, np.ndarray | None]:
        """The piece of an alignment, and which of its words lie in windows that agree; None if none does."""
        piece = code >> 40
        shift = (code & ((1 << 40) - 1)) - (1 << 39)
        item = self.words[piece]
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        same = doc[a + shift : b + shift] == item[a:b]
        covered = np.zeros(len(item), bool)
        if len(item) < WINDOW:
            covered[:] = len(same) == len(item) and same.all()
        elif len(same) >= WINDOW:
            agree = np.concatenate([[0], np.cumsum(same)])
            run = np.flatnonzero(agree[WINDOW:] - agree[:-WINDOW] >= WINDOW - SUBSTITUTED)
            edges = np.zeros(len(same) + 1, np.int64)
            edges[run] += 1
            edges[run + WINDOW] -= 1
            covered[a:b] = np.cumsum(edges)[:-1] > 0
        return piece, covered if covered.any() else None

    def hit(self, doc: np.ndarray) -> bool:
        """Whether some alignment holds a window that agrees."""
        return any(self._verified(doc, code)[1] is not None for code in self._alignments(doc).tolist())

    def matches(self, doc: np.ndarray) -> dict[int, int]:
        """Item row -> how many of its words some agreeing window covers, whatever pieces and alignments show them."""
        seen: dict[int, np.ndarray] = {}
        for code in self._alignments(doc).tolist():
            piece, covered = self._verified(doc, code)
            if covered is not None:
                row, start = self.owner[piece], self.starts[piece]
                whole = seen.setdefault(row, np.zeros(self.lengths[row], bool))
                whole[start : start + len(covered)] |= covered
        return {row: int(c.sum()) for row, c in seen.items()}


def _blocks(benchmark: DataFrame):
    """The query set in blocks of bounded bytes, in a fixed order."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    ids, texts, size = [], [], 0
    for r in rows.orderBy("item_id", F.xxhash64("text")).toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text.encode())
        if size >= BLOCK_BYTES:
            yield Block(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts)


def _slices(batches):
    """Batches of few rows: a task holds the lower-cased texts of one."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words): documents that hold a passage of an item, and how many of its words."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            block = shared.value
            for batch in _slices(batches):
                ids = batch.column(0).to_pylist()
                out = ([], [], [])
                for row, words in doc_words(pc.utf8_lower(batch.column(1)), gaps=PUNCTUATION):
                    for owner, n in block.matches(words).items():
                        for column, v in zip(out, (ids[row], block.ids[owner], n)):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "n_words"])

        parts.append(text.mapInArrow(tidy(run), "doc_id bigint, item_id bigint, n_words bigint"))
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, n_words bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; every block filters the rows where they lie."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            block = shared.value
            for batch in _slices(batches):
                keep = np.ones(batch.num_rows, bool)
                for row, words in doc_words(pc.utf8_lower(batch.column(at).cast(pa.string())), gaps=PUNCTUATION):
                    keep[row] = not block.hit(words)
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
