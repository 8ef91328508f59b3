"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from the seed and its code point. An n-gram binds
the vectors of its letters, each permuted (rotated) by its place, by multiplication; a text bundles its
n-grams by addition, and a language bundles its training texts. A text takes the language whose
prototype has the largest cosine with it. Text is lower-cased; everything but letters is a word gap.

Prototypes are sums of integers over all training rows, partial sums per task, so they do not depend
on partitioning; the model is one vector per language, whatever the input (LANGUAGES bounds it).

Edge cases: null text or text without letters is ``und`` with score 0, as is every text when nothing
could be learned; rows with null lang or null text teach nothing; a null doc_id counts as the empty
string in the fold rule; equal cosines take the first language in code point order; other columns are
ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, GRAM, SEED = 1024, 3, 5
LANGUAGES = 4096  # most languages a model may hold: 32 MB of prototypes
KNOWN = 16_384  # n-gram vectors a task keeps, 16 MB

_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x32000)])
    return _LETTER


class Encoder:
    """Bundles texts; keeps the bound vectors of the n-grams met so far."""

    def __init__(self):
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.table = np.zeros((KNOWN, DIM), np.int8)

    def _vector(self, cp: int) -> np.ndarray:
        if cp not in self.letter:
            self.letter[cp] = np.random.default_rng((SEED, cp)).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
        return self.letter[cp]

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        if len(self.row) + len(grams) > KNOWN:
            self.row.clear()
        if len(self.letter) > KNOWN:
            self.letter.clear()
        out = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            at = self.row.get(g)
            if at is None:
                at = self.row[g] = len(self.row)
                bound = np.ones(DIM, np.int8)
                for place in range(GRAM):
                    bound = bound * np.roll(self._vector(g >> 21 * place & 0x1FFFFF), place)
                self.table[at] = bound
            out[i] = at
        return out

    def bundle(self, text: str) -> np.ndarray | None:
        """Sum of the n-gram vectors of a text; None without a letter."""
        cps = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        known = _letters()
        letter = known[np.minimum(cps, len(known) - 1)]
        if not letter.any():
            return None
        cps = np.where(letter, cps, 32)
        cps = np.concatenate([[32], cps, [32]])
        cps = cps[np.concatenate([[True], (cps[1:] != 32) | (cps[:-1] != 32)])]
        grams = cps[2:] | cps[1:-1] << 21 | cps[:-2] << 42
        kinds, counts = np.unique(grams, return_counts=True)
        out = np.zeros(DIM)
        for at in range(0, len(kinds), 2048):
            rows = self._rows(kinds[at : at + 2048])
            out += counts[at : at + 2048].astype(np.float32) @ self.table[rows].astype(np.float32)
        return out


def _bundles_task(batches):
    encoder, sums = Encoder(), {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            v = encoder.bundle(text)
            if v is not None:
                sums[lang] = sums.get(lang, 0) + v.astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "profile"]
        )


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def prototypes(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes from rows (text, lang), all of them."""
    rows = train.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    partial = rows.mapInArrow(_bundles_task, "lang string, profile array<bigint>")
    summed = partial.select("lang", F.posexplode("profile").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    table = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("p")).select("lang", F.col("p.v").alias("v"))
    found = sorted(table.limit(LANGUAGES + 1).collect(), key=lambda r: r.lang.encode())
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    matrix = np.array([r.v for r in found], float).reshape(len(found), DIM)
    return [r.lang for r in found], matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        encoder, (langs, matrix) = Encoder(), model.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2):
                v = encoder.bundle(text.as_py()) if text.is_valid and langs else None
                norm = 0.0 if v is None else float(np.linalg.norm(v))
                if norm == 0:
                    names.append("und")
                    scores.append(0.0)
                    continue
                cosine = matrix @ v / norm
                best = int(np.argmax(cosine))
                names.append(langs[best])
                scores.append(float(min(1.0, max(0.0, cosine[best]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    return predict(docs, *prototypes(docs.where(~held_out(F.col("doc_id")))))
