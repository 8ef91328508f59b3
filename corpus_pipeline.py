"""Corpus pipeline: quality, near duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of documents.

Edge cases: an empty table stays empty in every stage. Null, empty and wordless texts pass the classifier, link with nothing, hold no
passage and have size zero, so the mix takes their floor of copies and they still get a shard; texts of any length
are read whole. Rows without doc_id take no part in the Jaccard join and stay. Rows repeated under one doc_id: the join
keeps one. Ties go to the smallest doc_id. Columns beside doc_id, text and source pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phasewise.llm import op01_jaccard, op03_decontaminate, op04_mixing, op06_quality, op07_sharding
from phasewise.llm.common import store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return op06_quality.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles reach similarity 0.8, directly or by steps, one stays."""
    return op01_jaccard.keep_one(docs, words=5, num=8, den=10)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return op03_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go as the target weights of their sources ask."""
    return op04_mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and place in it."""
    return op07_sharding.shard(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shards),
]

# The classifier, the seeds and CRC-32 have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = store(docs, f"stage{at}")
    return docs
