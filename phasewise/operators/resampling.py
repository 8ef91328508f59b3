"""Keyed resampling: folds, bootstrap, weighted and category-balanced draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasewise.functions.keyed import uniform
from phasewise.operators.order import lowest, running_sums, uniform_rank
from phasewise.session import join_small


def fold_assign(df: DataFrame, key: str, k: int, seed, by: Sequence[str] = (), name: str = "fold") -> DataFrame:
    """Shuffle, then deal rows to folds in turn: sizes differ by at most one."""
    d = df.withColumn("_u", uniform(seed, "fold", *by, key))
    return uniform_rank(d, "_u", key, by, "_r").withColumn(name, (F.col("_r") - 1) % k).drop("_u", "_r")


def holdout(df: DataFrame, key: str, share: float, seed, name: str = "train") -> DataFrame:
    """Exact train share (floor) by lowest keyed uniforms."""
    d = df.withColumn("_u", uniform(seed, "holdout", key))
    quota = df.agg(F.floor(F.count("*") * F.lit(share)).alias("_k"))
    return lowest(d, "_u", key, quota, "_k", name=name).drop("_u")


def bootstrap(df: DataFrame, key: str, replicates: int, seed) -> DataFrame:
    """n draws with replacement per replicate, as rows with a ``multiplicity``.

    Draw numbers are counted per row index before the join, so only indices travel.
    """
    n = df.count()
    indexed = uniform_rank(df.withColumn("_u", uniform(seed, "row", key)), "_u", key, name="_i").drop("_u")
    draws = (
        df.sparkSession.range(1, n + 1)
        .withColumn("imp_id", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .select("imp_id", (F.floor(uniform(seed, "boot", "imp_id", "id") * n) + 1).alias("_i"))
        .groupBy("imp_id", "_i")
        .agg(F.count("*").alias("multiplicity"))
    )
    return indexed.join(draws, "_i", "inner").drop("_i")


def weighted_resample(df: DataFrame, key: str, weight: str, n: int, seed) -> DataFrame:
    """n draws with replacement, probability proportional to ``weight``.

    Cumulative weights place each row on a line; draws are merged into the same order and
    a second prefix sum tells which row each draw falls on. No range join is needed.
    """
    rows = df.where(F.col(weight) > 0)
    slim = running_sums(rows.select(key, F.col(weight).cast("double").alias("_w")), [key], {"_c": "_w"})
    total = slim.agg(F.max("_c")).first()[0]
    draws = df.sparkSession.range(1, n + 1).select(
        (uniform(seed, "weighted", "id") * F.lit(total)).alias("_pos"), F.lit(1).alias("_kind"), F.col("id").alias("_id")
    )
    starts = slim.select((F.col("_c") - F.col("_w")).alias("_pos"), F.lit(0).alias("_kind"), F.col(key).cast("bigint").alias("_id"))
    line = running_sums(
        starts.unionByName(draws).withColumn("_isrow", F.lit(1) - F.col("_kind")), ["_pos", "_kind", "_id"], {"_rank": "_isrow"}
    )
    hits = line.where("_kind = 1").groupBy("_rank").agg(F.count("*").alias("multiplicity"))
    chosen = line.where("_kind = 0").join(hits, "_rank", "inner").select(F.col("_id").alias(key), "multiplicity")
    return df.join(chosen, key, "inner")


def even_by_category(df: DataFrame, column: str, key: str, n: int, seed) -> DataFrame:
    """n rows spread evenly over the levels of a column; small levels with replacement."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_size"))
    order = Window.orderBy(column)
    k = F.count("*").over(Window.partitionBy(F.lit(0)))
    quota = sizes.withColumn("_want", F.floor(F.lit(n) / k) + F.when(F.row_number().over(order) <= F.lit(n) % k, 1).otherwise(0))
    d = df.withColumn("_u", uniform(seed, "even", column, key))
    enough = quota.where("_size >= _want and _want > 0")
    out = lowest(d, "_u", key, enough, "_want", [column]).where("chosen").drop("chosen", "_u").withColumn("multiplicity", F.lit(1).cast("bigint"))
    short = quota.where("_size < _want")
    ranked = uniform_rank(join_small(d, short.select(column), [column], "inner"), "_u", key, [column], "_i").drop("_u")
    draws = (
        short.select(column, "_size", F.explode(F.sequence(F.lit(1), F.col("_want"))).alias("_d"))
        .select(column, (F.floor(uniform(seed, "again", column, "_d") * F.col("_size")) + 1).alias("_i"))
        .groupBy(column, "_i").agg(F.count("*").alias("multiplicity"))
    )
    return out.unionByName(ranked.join(draws, [column, "_i"], "inner").drop("_i"))
