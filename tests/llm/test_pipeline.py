"""The pipeline's stages against brute force, each on what the one before kept."""

import collections

import corpus_pipeline
from phasewise.llm import op03_decontaminate, op06_quality
from test_operators import components_of, rows_of, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        kept.append(docs)
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    raw, good, single, clean, mixed = kept
    assert {d for d, in rows_of(good, "doc_id")} == {d for d, in rows_of(op06_quality.score(raw).where("keep"), "doc_id")}
    root = components_of([(d, shingles(t, 5)) for d, t in rows_of(good, "doc_id", "text")], 8, 10)
    assert {d for d, in rows_of(single, "doc_id")} == {d for d, c in root.items() if c == d}
    hit = {d for d, in rows_of(op03_decontaminate.contaminated(single, spark.read.parquet(f"{SF}/benchmark.parquet")), "doc_id")}
    assert {d for d, in rows_of(clean, "doc_id")} == {d for d, in rows_of(single, "doc_id")} - hit
    copies = collections.Counter(d for d, in rows_of(mixed, "doc_id"))
    assert max(copies.values()) <= 3
    assert docs.count() == mixed.count()
    run = corpus_pipeline.run(spark, SF)
    assert sorted(rows_of(run, "doc_id", "shard")) == sorted(rows_of(docs, "doc_id", "shard"))


def test_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns pass every stage; an empty table stays empty."""
    docs, kept = odd_docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(collections.Counter(d for d, in rows_of(docs, "doc_id")))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == odd_docs.columns
        assert stage(spark, no_docs, SF).count() == 0
    good, single, clean, mixed, sharded = kept
    # without words: nothing to reject, nothing to link with
    assert {5, 6, 7} <= set(good) and {5, 6, 7} <= set(single) and {5, 6, 7} <= set(clean)
    copies = {1, 2, 3, 4, 14} & set(good)
    assert {1, 2, 3, 4, 14} & set(single) == ({min(copies)} if copies else set())
    assert all(n == 1 for d, n in single.items() if d is not None)
    assert single[None] == good[None] and clean <= single and sharded == mixed and set(mixed) <= set(clean)
