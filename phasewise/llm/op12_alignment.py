"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the same bytes. Every token points to the token that reaches farthest right among those
it overlaps; vectorised successor doubling takes each pointer to the terminal token of its component, which
labels the group. An overlap of one token of each side is a link; a pair of ids counts in how many documents
it is linked.

Both tokenizers here never look across a space between two visible characters (checked on their files: byte-level
BPE behind the usual pattern, and pieces that hold the space mark only in front). Text is therefore cut there
and every distinct word of a worker is encoded and aligned once; tokenizers that fail the check get whole texts.

The counts meet the links in two ways at once: the most frequent id pairs, as many as BROADCAST_BYTES hold,
are broadcast; occurrences of all the others are shuffled to their counts.

Edge cases: a null or empty text, and a text whose tokens do not join to the space and the text again (the space
mark itself, for one), has no tokens: zeros, and the empty string as its digest; texts of any length are aligned
whole; rows that repeat count as documents of their own; a null doc_id stays a row; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.llm.common import BROADCAST_BYTES, discard, store

CACHE_WORDS = 150_000
DOCS = 64
LINE = 500  # words encoded together
PAIR_BYTES = 40  # of a broadcast id pair
MARK = "▁"
# Between two visible characters; Python's white space holds all of the pattern's.
_CUT = re.compile(r" (?=\S)(?<=\S )")


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer file of byte-level BPE; the text gets a space in front."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(spec)
        self.tool.encode_special_tokens = True
        parts = json.loads(spec)
        pre = parts["pre_tokenizer"] or {}
        self.cuts_at_spaces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and parts["normalizer"] is None
        byte = byte_alphabet()
        self.bytes = [b""] * self.tool.get_vocab_size()
        for token, i in self.tool.get_vocab().items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        many = getattr(self.tool, "encode_batch_fast", self.tool.encode_batch)
        return [e.ids for e in many([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Model file of pieces with byte fallback; the model puts the space in front."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.tool.id_to_piece(i) for i in range(self.tool.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.tool.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)
        ]
        self.cuts_at_spaces = not any(MARK in p.lstrip(MARK) for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tool.encode(texts, num_threads=1)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terminal of every A and every B token, by pointer jumping; both sides cover the same bytes.

    Tokens are numbered A first, then B. A token points to its farthest-right overlapping token, the one of the
    other side that holds its last byte; a B token that no A token outreaches is a terminal.
    """
    n = len(ends_a)
    over_b = np.searchsorted(ends_b, ends_a)
    over_a = np.searchsorted(ends_a, ends_b)
    own = n + np.arange(len(ends_b))
    points = np.concatenate([n + over_b, np.where(ends_a[over_a] > ends_b, over_a, own) if n else own])
    while True:
        further = points[points]
        if (further == points).all():
            return points[:n], points[n:]
        points = further


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of an A and a B token with a common byte, left to right."""
    cuts = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)


class Aligner:
    """Aligned words: (groups as text, id pairs as bytes, A tokens, B tokens, groups), or None without tokens."""

    def __init__(self, spec: str, model: bytes):
        self.a, self.b = ByteLevel(spec), Pieces(model)
        self.width = len(self.b.bytes)
        self.by_word = self.a.cuts_at_spaces and self.b.cuts_at_spaces
        most = max(len(self.a.bytes), self.width)
        self.texts = [f"{i}{end}" for end in ",|;" for i in range(most)]
        self.most = most
        self.len_text = np.array([len(x) for x in self.texts])
        self.len_a, self.len_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.known: dict[str, tuple | None] = {}

    def words(self, text: str | None) -> list[str]:
        return _CUT.split(text) if text and self.by_word else [text] if text else []

    def learn(self, new: list[str]) -> None:
        """Encode and align new words, LINE of them on one line; words that would run together on a line go alone."""
        lines, line = [], []
        for w in new:
            if not self.by_word or w[0].isspace() or w[-1].isspace() or MARK in w:
                lines.append([w])
                continue
            line.append(w)
            if len(line) == LINE:
                lines.append(line)
                line = []
        for words in [*lines, line] if line else lines:
            if not self._learn(words):
                for w in words:
                    if len(words) == 1 or not self._learn([w]):
                        self.known[w] = None

    def _learn(self, words: list[str]) -> bool:
        """Learn the words of one line; False if its tokens do not join to it."""
        text = " ".join(words)
        ids_a, ids_b = (side.encode([text])[0] for side in (self.a, self.b))
        raw = b" " + text.encode()
        if not b"".join(map(self.a.bytes.__getitem__, ids_a)) == raw == b"".join(map(self.b.bytes.__getitem__, ids_b)):
            return False
        flat_a, flat_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        ends = np.cumsum([1 + len(w.encode()) for w in words])
        last_a, last_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        if (ends_a[last_a] != ends).any() or (ends_b[last_b] != ends).any():
            return False
        group_a, group_b = groups(ends_a, ends_b)
        label = np.concatenate([group_a, group_b])
        side = np.repeat([0, 1], [len(flat_a), len(flat_b)])
        order = np.argsort(2 * label + side, kind="stable")
        label, side, ids = label[order], side[order], np.concatenate([flat_a, flat_b])[order]
        last_group = np.append(label[1:] != label[:-1], True)
        end = np.where(last_group, 2, np.append(side[1:] != side[:-1], True).astype(np.int64))
        places = end * self.most + ids
        written = "".join(map(self.texts.__getitem__, places.tolist()))
        link_a, link_b = overlaps(ends_a, ends_b)
        codes = (flat_a[link_a] * self.width + flat_b[link_b]).tobytes()
        cut_a, cut_b = last_a + 1, last_b + 1
        cut_t = cut_a + cut_b
        cut_g = np.cumsum(last_group)[cut_t - 1]
        cut_c = np.cumsum(self.len_text[places])[cut_t - 1]
        cut_l = 8 * np.searchsorted(link_a, cut_a)
        count = lambda cuts: np.diff(cuts, prepend=0).tolist()
        c = l = 0
        for w, cc, ll, x, y, g in zip(words, cut_c.tolist(), cut_l.tolist(), count(cut_a), count(cut_b), count(cut_g)):
            self.known[w] = (written[c : cc - 1], codes[l:ll], x, y, g)
            c, l = cc, ll
        return True

    def align(self, texts: list[str | None]) -> list[tuple | None]:
        """(groups as text, id pair of every link, A tokens, B tokens, groups) of each text; None without tokens."""
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set().union(*split) - self.known.keys())
        if new:
            self.learn(new)
        out = []
        for words in split:
            found = [self.known[w] for w in words]
            if not found or None in found:
                out.append(None)
                continue
            text, codes, n_a, n_b, n_groups = zip(*found)
            out.append((";".join(text), np.frombuffer(b"".join(codes), np.int64), sum(n_a), sum(n_b), sum(n_groups)))
        return out


_READY: dict[int, Aligner] = {}


def _aligner(spec: str, model: bytes) -> Aligner:
    """One aligner for a worker process: later tasks go on with the words it knows."""
    key = zlib.crc32(spec.encode(), zlib.crc32(model))
    if key not in _READY:
        _READY.clear()
        _READY[key] = Aligner(spec, model)
    return _READY[key]


_I64 = pa.int64()
ROWS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes array<bigint>, times array<bigint>"


def _align_task(spec, model, keep_groups: bool):
    def run(batches):
        tool = _aligner(spec.value, model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                ids, texts = (batch.column(c).slice(at, DOCS) for c in (0, 1))
                counts, sums, written, codes, times = [], [], [], [], []
                for found in tool.align(texts.to_pylist()):
                    if found is None:
                        counts.append((0, 0, 0, 0))
                        sums.append("")
                        written.append("")
                        codes.append(np.zeros(0, np.int64))
                        times.append(codes[-1])
                        continue
                    text, links, n_a, n_b, n_groups = found
                    counts.append((n_a, n_b, n_groups, len(links)))
                    sums.append(hashlib.sha256(text.encode()).hexdigest())
                    written.append(text)
                    pair, n = np.unique(links, return_counts=True)
                    codes.append(pair)
                    times.append(n)
                offsets = pa.array(np.cumsum([0, *map(len, codes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), _I64)) for x in (codes, times)]
                columns = [ids, *(pa.array(c, _I64) for c in zip(*counts)), pa.array(sums, pa.string()), *lists]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]
                if keep_groups:
                    columns.append(pa.array(written, pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def align(docs: DataFrame, byte_level_file: str, piece_file: str, keep_groups: bool = False) -> tuple[DataFrame, int]:
    """Aligned rows of ``docs`` (doc_id, text) with their distinct id pairs, and how many ids side B has.

    ``codes`` holds A id * that number + B id, ``times`` its links; ``groups`` is kept on demand.
    """
    context = docs.sparkSession.sparkContext
    with open(byte_level_file, encoding="utf-8") as f:
        spec = context.broadcast(f.read())
    with open(piece_file, "rb") as f:
        model = context.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = ROWS + (", groups string" if keep_groups else "")
    return rows.mapInArrow(_align_task(spec, model, keep_groups), kind), len(Pieces(model.value).bytes)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(code, docs, best): documents that link each id pair; ``best`` where no pair of its A id has more."""
    counts = store(aligned.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("docs")), "counts")
    counts = counts.withColumn("a", F.expr(f"code div {width}"))
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(highest, "a").select("code", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _frequent(pairs: DataFrame, rows: int) -> int:
    """Smallest power of two so that at most ``rows`` pairs have that many documents or more."""
    sizes = pairs.groupBy(F.floor(F.log2("docs")).cast("int").alias("k")).count().collect()  # at most 63 rows
    power, total = 63, 0
    for k, n in sorted(((r["k"], r["count"]) for r in sizes), reverse=True):
        total += n
        if total > rows:
            break
        power = k
    return 1 << power if power < 63 else (1 << 63) - 1


def agreement(docs: DataFrame, byte_level_file: str, piece_file: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``."""
    rows, width = align(docs, byte_level_file, piece_file)
    rows = store(rows.withColumn("at", F.monotonically_increasing_id()), "aligned")
    pairs = store(pair_counts(rows, width), "pairs")
    least = _frequent(pairs, broadcast_bytes // PAIR_BYTES)
    frequent, rare = pairs.where(f"docs >= {least}"), pairs.where(f"docs < {least}")
    links = rows.select("at", F.inline(F.arrays_zip("codes", "times"))).withColumnRenamed("codes", "code")
    sums = [F.sum(F.expr("CASE WHEN best THEN times ELSE 0 END")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")]
    found = links.join(F.broadcast(frequent), "code").groupBy("at").agg(*sums)
    if not rare.isEmpty():
        others = links.join(F.broadcast(frequent.select("code")), "code", "left_anti")
        found = found.unionByName(others.join(rare, "code").groupBy("at").agg(*sums))
        found = found.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    some = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = rows.drop("codes", "times").join(found, "at", "left")
    out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", some("n_best"), some("count_sum"), "groups_sha256")
    out = store(out, "agreement")
    discard(rows, pairs)
    return out
