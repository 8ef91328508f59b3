"""Readers and writers: cohort CSV, stacked imputations, samples, run logs, estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESTIMATE_SCHEMA = T.StructType([
    T.StructField("rep", T.IntegerType()),
    T.StructField("design", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("estimate", T.DoubleType()),
    T.StructField("se", T.DoubleType()),
    T.StructField("lower", T.DoubleType()),
    T.StructField("upper", T.DoubleType()),
])


def read_cohort(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV: index columns dropped, names trimmed, columns cast to ``schema``."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.select(*[
        F.col(f"`{c}`").alias(c.strip()) for c in raw.columns if c.strip() and not c.strip().startswith(("Unnamed", "_c"))
    ])
    if schema is None:
        return raw
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def write_stacked(df: DataFrame, path: str) -> None:
    """All completed tables in one dataset, one folder per imputation."""
    df.write.mode("overwrite").partitionBy("imp_id").parquet(path)


def read_stacked(spark: SparkSession, path: str, imputations: Sequence[int] | None = None) -> DataFrame:
    """Read back; asking for some imputations reads only their folders."""
    df = spark.read.parquet(path)
    return df.where(F.col("imp_id").isin(*imputations)) if imputations is not None else df


def write_samples(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sampled cohorts by (type, design, rep); only the written partitions are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("type", "design", "rep").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pending_work(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items without output yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def run_log(df: DataFrame, started: float, finished: float, keys: Sequence[str]) -> DataFrame:
    """Elapsed seconds per work item (items of one job share its wall-clock time)."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).withColumn(
        "seconds", F.lit(float(finished - started))
    )


def append_run_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def estimates_table(*tables: DataFrame) -> DataFrame:
    """All methods in one long table with fixed columns."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in ESTIMATE_SCHEMA.fields]
    out = None
    for t in tables:
        part = t.select(*cols)
        out = part if out is None else out.unionByName(part)
    return out


def write_estimates(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("method").parquet(path)


def stack(*tables: DataFrame) -> DataFrame:
    """Row-bind by name; columns absent from one table become NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
