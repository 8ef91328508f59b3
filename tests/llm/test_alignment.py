"""Cross-tokenizer alignment against a slow version that encodes whole texts."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phasewise.llm import op12_alignment as alignment
from test_operators import rows_of

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

_a = Tokenizer.from_file(A)
_a.encode_special_tokens = True
_b = sentencepiece.SentencePieceProcessor(model_file=B)
_bytes = alignment.byte_alphabet()


def slow_tokens(text):
    """(A ids and ends, B ids and ends) of a whole text, or None."""
    if not text:
        return None
    a = _a.encode(" " + text, add_special_tokens=False).ids
    b = _b.encode(text)
    raw_a = [bytes(_bytes[c] for c in _a.id_to_token(i)) for i in a]
    raw_b = [bytes([int(_b.id_to_piece(i)[3:5], 16)]) if _b.is_byte(i) else _b.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    return (a, np.cumsum([*map(len, raw_a)]).tolist()), (b, np.cumsum([*map(len, raw_b)]).tolist())


def slow_rows(rows):
    docs, count = [], collections.Counter()
    for d, text in rows:
        found = slow_tokens(text)
        if found is None:
            docs.append((d, 0, 0, [], ""))
            continue
        (a, ea), (b, eb) = found
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        links, j0 = [], 0
        for i in range(len(a)):
            while eb[j0] <= sa[i]:
                j0 += 1
            j = j0
            while j < len(b) and sb[j] < ea[i]:
                links.append((a[i], b[j]))
                j += 1
        both = sorted(set(ea) & set(eb))
        text, i, j = [], 0, 0
        for cut in both:
            ii, jj = ea.index(cut, i) + 1, eb.index(cut, j) + 1
            text.append(",".join(map(str, a[i:ii])) + "|" + ",".join(map(str, b[j:jj])))
            i, j = ii, jj
        docs.append((d, len(a), len(b), links, ";".join(text)))
        count.update(set(links))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [
        (d, na, nb, text.count(";") + 1 if text else 0, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(text.encode()).hexdigest() if text else "")
        for d, na, nb, links, text in docs
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "plain words here", " leading", "trailing ", "two  spaces   three", "tab\tand\nline \n mixed \r\n", "<|endoftext|> and <s> </s> <unk>", "a▁b",
    "x y   z", "　wide  em", "naïve façade über 漢字 かな 한국어 🙂🙂", "don't we'll 'tis 12345 3.14e-9", "\x00\x01 \x1c \x1f.", " ", "\n", "  ",
    "word́ combining", "<0x41> literal", "…!?", "ABCabc" * 40, "​zero ﻿ width", "a \x85b", "ﬁ ﬂ ①",
]


@pytest.mark.parametrize("room", [1 << 24, 40 * 60, 0])
def test_whole_query(spark, odd_docs, no_docs, room):
    """Counts broadcast as a whole, in part and not at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 20000")
    extra = spark.createDataFrame([(5_000_000 + i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    odd = odd_docs.where("coalesce(length(text), 0) < 20000").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    docs = docs.unionByName(extra).unionByName(odd)
    key = lambda r: (r[0] is None, r[0] or 0, r)
    got = sorted(rows_of(alignment.agreement(docs, A, B, room), *COLUMNS), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert got == sorted(slow_rows(rows_of(docs, "doc_id", "text")), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert alignment.agreement(no_docs, A, B, room).count() == 0


def test_long_texts(spark, odd_docs):
    got = {r[0]: r[1:] for r in rows_of(alignment.agreement(odd_docs.where("doc_id IN (11, 12)"), A, B), *COLUMNS)}
    for d, text in rows_of(odd_docs.where("doc_id IN (11, 12)"), "doc_id", "text"):
        (a, ea), (b, eb) = slow_tokens(text)
        both = len(set(ea) & set(eb))
        assert got[d][:4] == (len(a), len(b), both, len(a) + len(b) - both)


def test_words_equal_whole_texts():
    tool = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    assert tool.by_word
    by_word = tool.align(TEXTS)
    tool.by_word, tool.known = False, {}
    for text, x, y in zip(TEXTS, by_word, tool.align(TEXTS)):
        assert (x is None) == (y is None), text
        if x is not None:
            assert x[0] == y[0] and x[1].tolist() == y[1].tolist() and x[2:] == y[2:]


def test_pointers_reach_common_ends():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 200))
        ends = [np.append(np.flatnonzero(rng.random(n) < p) + 1, n + 1) for p in rng.random(2)]
        a, b = alignment.groups(*ends)
        common = np.intersect1d(*ends)
        for side, e in ((a, ends[0]), (b, ends[1])):
            assert (ends[1][side - len(ends[0])] == common[np.searchsorted(common, e)]).all()


def test_groups_on_demand(spark):
    docs = spark.createDataFrame([(1, "unbelievable words"), (2, None)], "doc_id bigint, text string")
    rows, width = alignment.align(docs, A, B, keep_groups=True)
    got = dict(rows_of(rows, "doc_id", "groups"))
    assert width == 32000 and got[2] == ""
    assert hashlib.sha256(got[1].encode()).hexdigest() == slow_rows([(1, "unbelievable words")])[0][-1]
