"""Repeated runs meet by their least hash: in one task as stretches, or by aggregates where a hash has many places."""

import numpy as np
import pyarrow as pa

from phasewise.llm import op09_substring as op

SF = "/root/testdata/sf0.001"


def test_a_repeated_passage_is_one_row():
    words = [f"w{i}" for i in range(200)]
    texts = pa.array([" ".join(words), "before " + " ".join(words), " ".join(words[:120] + ["x"] + words[120:])])
    least = np.concatenate([op._least(w) for _, w in op.doc_words(texts)])
    kinds = pa.array([op.signed(np.unique(least))] * 3, pa.list_(pa.int64()))
    none = pa.array([[]] * 3, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), texts, pa.array([None] * 3), kinds, none], ["doc_id", "text", "gone", "wanted", "hot"])
    sent = pa.Table.from_batches(op._windows_task([batch])).drop_columns("hot")
    assert sent.num_rows < 100  # of 415 runs
    rows = sent.sort_by([(c, "ascending") for c in ("least", "doc_id", "at")])
    found = [r for b in op._later_task(rows.to_batches()) for r in b.to_pylist()]
    places = sorted((r["doc_id"], r["at"] + k, r["keep_doc_id"], r["keep_word"] + k) for r in found for k in range(r["n"]))
    want = [(2, i + 1, 1, i) for i in range(151)] + [(3, i, 1, i) for i in range(71)] + [(3, i + 1, 1, i) for i in range(120, 151)]
    assert places == sorted(want)


def test_many_places_of_a_hash_give_the_same_spans(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(5))
    none = spark.createDataFrame([], "doc_id bigint, part int")
    few = sorted(map(tuple, op.spans(docs, none).collect()))
    monkeypatch.setattr(op, "MEET", 1)
    assert few and sorted(map(tuple, op.spans(docs, none).collect())) == few
