"""Quality by weak labels: EM over overlapping heuristics, then a hashed linear scorer.

LABELLERS are rules that vote good (1), bad (0) or abstain (2). Votes of all documents are counted by
pattern (at most 3^9 rows, whatever the input); expectation-maximisation on the counts estimates how
often each rule votes which way on good and on bad documents, with no true label. The posterior of a
document's votes labels it. A logistic scorer over hashed features learns the posteriors of a bounded,
hash-drawn sample (SAMPLE documents expected, DIM features) and scores every document; below CUT it is
rejected.

Features are runs of character classes (hashed 4-grams of class codes) and binned measures of repetition.

Texts of fewer than MIN_WORDS words, which may be long where no spaces are written, give the rules too
little, so all abstain. A second scorer, which sees characters only (CHARACTERS), judges them. It learns
from the same sample, whole texts and beginnings of a few words, what the rules on characters say.

Edge cases: null and empty texts and texts without a word are kept and score by the prior; repeated rows score alike; an empty table gives
no rows; other columns are ignored by ``score`` and pass through ``accept``.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.functions import keyed
from phasewise.llm.common import doc_words, tidy

DIM, SAMPLE, MIN_WORDS, CUT = 512, 8192, 8, 0.5
STEPS, RATE, RIDGE, ROUNDS = 400, 2.0, 1e-4, 60
GOOD, BAD, ABSTAIN = 1, 0, 2

# Character classes: other, lower, upper, digit, space, sentence mark, bracket or quote, symbol.
_CLASS = None
_SENTENCE, _QUOTE = set(".,;:?'-¿¡"), set("()\"«»“”‘’")


def _classes() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        def kind(c: int) -> int:
            ch = chr(c)
            if ch in _SENTENCE:
                return 5
            if ch in _QUOTE:
                return 6
            cat = unicodedata.category(ch)
            if cat == "Lu":
                return 2
            if cat[0] in "LM":
                return 1
            if cat[0] == "N":
                return 3
            if cat[0] == "Z" or c in (9, 10, 11, 12, 13):
                return 4
            return 7 if cat[0] in "PS" else 0

        _CLASS = np.array([kind(c) for c in range(0x32000)], np.uint8)
    return _CLASS


def measures(text: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(measures, counts of class 4-grams) of one text; ``words`` are its word hashes."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    table = _classes()
    kind = table[np.minimum(cps, len(table) - 1)]
    n = np.bincount(kind, minlength=8)
    letters, chars, count = n[1] + n[2], max(1, len(cps) - n[4]), max(1, len(words))
    same_next = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
    kinds, times = np.unique(words, return_counts=True)
    m = np.array([
        n[7] / count,  # symbols a word
        n[2] / max(1, letters),  # upper case among letters
        same_next,  # words equal to the one before
        times.max() / count if len(words) else 0.0,  # share of the commonest word
        len(kinds) / min(count, 200) if len(words) else 0.0,  # variety
        (letters + n[3]) / chars,  # letters and digits among visible characters
        letters / count,  # letters a word
        n[3] / chars,  # digits
        n[5] / count,  # sentence marks a word
        n[0] / chars,  # control and unassigned characters
    ])
    padded = np.concatenate([[4, 4], kind, [4]]).astype(np.int64)
    grams = padded[3:] | padded[2:-1] << 3 | padded[1:-2] << 6 | padded[:-3] << 9 if len(padded) > 3 else padded[:0]
    return m, np.bincount(grams, minlength=4096)


# Rule: (measure, bad from, bad below, good from, good below); outside both it abstains.
LABELLERS = {
    "few symbols": (0, 0.30, np.inf, 0.0, 0.10),
    "not shouted": (1, 0.50, np.inf, 0.0, 0.20),
    "no stutter": (2, 0.25, np.inf, 0.0, 0.08),
    "no ruling word": (3, 0.40, np.inf, 0.0, 0.22),
    "varied words": (4, -np.inf, 0.15, 0.35, np.inf),
    "mostly letters": (5, -np.inf, 0.65, 0.85, np.inf),
    "word length": (6, 14.0, np.inf, 2.0, 10.0),
    "few digits": (7, 0.60, np.inf, 0.0, 0.10),
    "clean characters": (9, 0.05, np.inf, -1.0, 0.005),
}


# Measures that need no words, and the rules a few words can inherit from their text.
CHARACTERS = (1, 5, 7, 9)
_CHARACTER_RULES = np.array([at in (0, *CHARACTERS) for at, *_ in LABELLERS.values()])


def votes(m: np.ndarray, n_words: int) -> np.ndarray:
    if n_words < MIN_WORDS:
        return np.full(len(LABELLERS), ABSTAIN)
    out = []
    for at, bad_from, bad_below, good_from, good_below in LABELLERS.values():
        v = m[at]
        out.append(BAD if bad_from <= v < bad_below else GOOD if good_from <= v < good_below else ABSTAIN)
    return np.array(out)


def _bin(i: int, v: float) -> int:
    cell = i * 64 + int(np.clip(np.log2(max(v, 0) + 1 / 64) * 3 + 32, 0, 63))
    return (cell * 0x9E3779B1 >> 7) % DIM


def features(m: np.ndarray, grams: np.ndarray, only: tuple | None = None) -> np.ndarray:
    """Hashed features: square roots of class 4-gram shares, and a bin for each measure (of ``only``)."""
    used = np.flatnonzero(grams)
    x = np.zeros(DIM, np.float32)
    slot = (used.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 9)
    np.add.at(x, slot.astype(np.int64), np.sqrt(grams[used] / max(1, grams.sum())))
    for i, v in enumerate(m):
        if only is None or i in only:
            x[_bin(i, v)] += 1.0
    return x


def _beginning(text: str, words: np.ndarray) -> np.ndarray:
    """Character features of the first one to seven words of a text."""
    most = 1 + int(words[0]) % (MIN_WORDS - 1)
    parts = text.split(None, most)
    first = text[: len(text) - len(parts[most])].strip() if len(parts) > most else text
    return features(*measures(first, words[:most]), CHARACTERS)


def _walk(batch, column: int):
    """(row, measures, grams, number of words) of every text of a batch; null counts as empty."""
    texts = batch.column(column)
    for row, words in doc_words(texts):
        m, grams = measures(texts[row].as_py() or "", words)
        yield row, m, grams, len(words)


def _pattern(v: np.ndarray) -> int:
    return int((v * 3 ** np.arange(len(v))).sum())


def fit_em(patterns: dict[int, int]) -> tuple[float, np.ndarray]:
    """(share of good, P(vote | class) as [rule, class, vote]) from counts of vote patterns."""
    rules = len(LABELLERS)
    codes = np.array(sorted(patterns), np.int64)
    weight = np.array([patterns[int(c)] for c in codes], float)
    v = codes[:, None] // 3 ** np.arange(rules) % 3
    good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    # start: any bad vote makes a document doubtful, since rules look for different faults
    post = np.where(bad > 0, 0.1, np.where(good > 0, 0.95, 0.9))
    prior, table = 0.9, np.full((rules, 2, 3), 1 / 3)
    for _ in range(ROUNDS):
        mass = np.stack([weight * (1 - post), weight * post])
        prior = (mass[1].sum() + 9) / (weight.sum() + 10)
        for vote in (BAD, GOOD, ABSTAIN):
            table[:, :, vote] = ((mass[:, :, None] * (v == vote)[None]).sum(axis=1).T + np.array([[1.0, 1.0]]))
        table /= table.sum(axis=2, keepdims=True)
        post = posterior(v, prior, table)
    return prior, table


def posterior(v: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """P(good | votes), abstentions telling nothing."""
    log = np.log(table)
    spoken = v != ABSTAIN
    rules = np.arange(v.shape[-1])
    gain = np.where(spoken, log[rules, 1, v] - log[rules, 0, v], 0.0).sum(axis=-1)
    return 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + gain, -60, 60)))


def fit_scorer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (last one the intercept) by gradient steps on soft labels."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1])
    # both classes weigh alike, so that rare bad documents are learned
    share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
    balance = y / share + (1 - y) / (1 - share)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        w -= RATE * (x.T @ ((p - y) * balance) / max(1, 2 * len(y)) + RIDGE * w)
    return w


def _patterns_task(batches):
    seen: dict[int, int] = {}
    for batch in batches:
        for _, m, _, n in _walk(batch, 0):
            code = _pattern(votes(m, n))
            seen[code] = seen.get(code, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])


def _features_task(batches):
    for batch in batches:
        x, short, bins, code = [], [], [], []
        for row, words in doc_words(batch.column(0)):
            text = batch.column(0)[row].as_py() or ""
            m, grams = measures(text, words)
            x.append(features(m, grams, CHARACTERS).tobytes())
            short.append(_beginning(text, words).tobytes() if len(words) else x[-1])
            bins.append([_bin(i, v) for i, v in enumerate(m) if i not in CHARACTERS])
            code.append(_pattern(votes(m, len(words))))
        kinds = (pa.binary(), pa.binary(), pa.list_(pa.int16()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((x, short, bins, code), kinds)], ["x", "short", "bins", "pattern"])


def fit(docs: DataFrame) -> dict:
    """The model: EM over the votes of all documents, scorer from a bounded sample of them."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    counts = text.mapInArrow(tidy(_patterns_task), "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    patterns = {r.pattern: r.n for r in counts.collect()}
    total = sum(patterns.values())
    if not total:
        return {"weights": np.zeros(DIM + 1)}
    prior, table = fit_em(patterns)
    # equal rows draw the same number: they count once, in the number of rows to draw from and in the sample
    key = F.xxhash64("doc_id", "text")
    kinds = docs.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    drawn = docs.where(keyed.uniform(6, "quality", key) * kinds < SAMPLE).select("doc_id", F.col("text").cast("string").alias("text")).distinct()
    rows = drawn.select("text").mapInArrow(tidy(_features_task), "x binary, short binary, bins array<smallint>, pattern bigint").collect()
    spoken = [r for r in sorted(rows, key=lambda r: (r.x, r.short)) if r.pattern != _pattern(np.full(len(LABELLERS), ABSTAIN))]
    x, short = (np.array([np.frombuffer(r[c], np.float32) for r in spoken], np.float32).reshape(-1, DIM) for c in ("x", "short"))
    v = np.array([r.pattern for r in spoken], np.int64)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    by_characters = np.where(_CHARACTER_RULES, v, ABSTAIN)
    told = (by_characters != ABSTAIN).any(axis=1)
    few = fit_scorer(np.vstack([x[told], short[told]]), np.tile(posterior(by_characters[told], prior, table), 2))
    # the classes weigh alike in the fit; few characters say little, so here their shares count again
    few[-1] += np.log(prior / (1 - prior))
    for row, one in zip(x, spoken):
        np.add.at(row, one.bins, 1.0)
    return {"weights": fit_scorer(x, posterior(v, prior, table)), "few": few, "prior": prior, "table": table}


def _score(model: dict, m, grams, n) -> float:
    if not n:
        return float(model.get("prior", 0.5))
    w, only = (model["weights"], None) if n >= MIN_WORDS else (model["few"], CHARACTERS)
    z = float(features(m, grams, only) @ w[:-1] + w[-1])
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, score, keep) for every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for batch in batches:
            s, keep = [], []
            for _, m, grams, n in _walk(batch, 1):
                s.append(_score(model.value, m, grams, n))
                keep.append(not n or s[-1] >= CUT)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array(keep, pa.bool_())], ["doc_id", "score", "keep"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, score double, keep boolean")


def accept(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows the scorer rejects, filtered where they lie."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, m, grams, n in _walk(batch, at):
                keep[row] = not n or _score(model.value, m, grams, n) >= CUT
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)
