"""Stratum tables: allocation of a sample over strata, quotas, weights, merges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasewise.session import join_small, local_frame, settle


def _per_group(table: DataFrame, by: Sequence[str], fn, schema: T.StructType) -> DataFrame:
    """Run a small numpy function on each group's stratum table."""
    rows, small = settle(table)
    if small:
        pdf = rows.toPandas()
        parts = [fn(g) for _, g in pdf.groupby(list(by), sort=False)] if by else [fn(pdf)]
        return local_frame(table.sparkSession, pd.concat(parts, ignore_index=True), schema)
    keys = list(by) or [F.lit(0)]
    return rows.groupBy(*keys).applyInPandas(fn, schema)


def priority_counts(ns: np.ndarray, units: int, cap: np.ndarray | None = None) -> np.ndarray:
    """How many of the ``units`` largest ns/sqrt(j(j+1)), j = 2, 3, ..., fall in each stratum.

    The list is never built: the count above a threshold has a closed form, and the threshold
    is found by bisection. Work does not depend on the sample size.
    """
    k = len(ns)
    out = np.zeros(k, dtype=np.int64)
    if units <= 0 or k == 0:
        return out
    limit = np.full(k, np.iinfo(np.int64).max // 4) if cap is None else np.maximum(cap, 0)
    positive = ns > 0
    if cap is not None:
        units = int(min(units, limit[positive].sum())) if positive.any() else 0

    def value(j):
        return ns / np.sqrt(j * (j + 1.0))

    def count(tau):
        q = ns / tau
        j = np.maximum(np.floor((np.sqrt(1.0 + 4.0 * q * q) - 1.0) / 2.0), 1.0)
        j = np.where((value(j) < tau) & (j > 1), j - 1, j)
        j = np.where(value(j + 1) >= tau, j + 1, j)
        return np.minimum(np.where(positive, np.maximum(j - 1, 0), 0), limit)

    if positive.any() and units > 0:
        lo, hi = 0.0, float(ns.max())
        for _ in range(4000):
            mid = 0.5 * (lo + hi)
            if mid <= lo or mid >= hi:
                break
            if count(mid).sum() >= units:
                lo = mid
            else:
                hi = mid
        out = count(hi).astype(np.int64)
        while out.sum() < units:  # ties at the threshold: larger ns first, then stratum order
            nxt = np.where(positive & (out < limit), value(out + 2.0), -1.0)
            out[int(np.argmax(nxt))] += 1
    elif cap is None:
        out[0] = units
    return out


def exact_allocation(df: DataFrame, stratum: str, target: str, n: int, cap: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Optimal integer allocation: two per stratum, the rest by priority values.

    Returns ``by``, stratum, ``size``, ``sd`` and ``alloc``; ``cap`` keeps alloc <= size.
    """
    by = list(by)
    table = df.groupBy(*by, stratum).agg(
        F.count("*").alias("size"), F.coalesce(F.stddev_samp(target), F.lit(0.0)).alias("sd")
    )
    schema = T.StructType([df.schema[c] for c in [*by, stratum]] + [
        T.StructField("size", T.LongType()), T.StructField("sd", T.DoubleType()), T.StructField("alloc", T.LongType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ns = (pdf["size"] * pdf["sd"]).to_numpy(dtype=float)
        pdf = pdf.assign(_ns=ns).sort_values(["_ns", stratum], ascending=[False, True])
        room = (pdf["size"].to_numpy() - 2) if cap else None
        extra = priority_counts(pdf["_ns"].to_numpy(), int(n) - 2 * len(pdf), room)
        alloc = 2 + extra
        if cap:
            alloc = np.minimum(alloc, pdf["size"].to_numpy())
        return pdf.assign(alloc=alloc.astype(np.int64))[[f.name for f in schema.fields]]

    return _per_group(table, by, solve, schema)


def balanced_quota(df: DataFrame, stratum: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """floor(n/k) per stratum (all rows of smaller ones); the remainder over open strata in order."""
    by = list(by)
    table = df.groupBy(*by, stratum).agg(F.count("*").alias("size"))
    schema = T.StructType([df.schema[c] for c in [*by, stratum]] + [
        T.StructField("size", T.LongType()), T.StructField("alloc", T.LongType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(stratum)
        size = pdf["size"].to_numpy(dtype=np.int64)
        alloc = np.minimum(size, int(n) // len(size))
        left = min(int(n), int(size.sum())) - int(alloc.sum())
        while left > 0:
            is_open = size > alloc
            share = -(-left // int(is_open.sum()))
            give = np.where(is_open, np.minimum(share, size - alloc), 0)
            before = np.concatenate([[0], np.cumsum(give)[:-1]])
            give = np.clip(left - before, 0, give)
            alloc = alloc + give
            left -= int(give.sum())
        return pdf.assign(alloc=alloc)[[f.name for f in schema.fields]]

    return _per_group(table, by, solve, schema)


def design_weights(df: DataFrame, stratum: str, r: str = "R", by: Sequence[str] = ()) -> DataFrame:
    """Per stratum: sizes, weight N/n and selection share n/N."""
    t = df.groupBy(*by, stratum).agg(F.count("*").alias("size"), F.sum(F.col(r).cast("bigint")).alias("chosen"))
    return t.withColumns({
        "weight": F.when(F.col("chosen") > 0, F.col("size") / F.col("chosen")), "share": F.col("chosen") / F.col("size"),
    })


def merge_lone_strata(df: DataFrame, stratum: str) -> DataFrame:
    """A stratum with one row moves to the nearest larger stratum with the same flag.

    Labels read ``flag.level1.level2...``; distance is the sum of absolute level differences,
    ties go to the smaller label. Adds ``fpc``, the size of the stratum moved to.
    """
    part = F.split(stratum, r"\.")
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n")).withColumns({
        "_flag": part[0], "_l1": part[1].try_cast("int"), "_l2": part[2].try_cast("int")})
    sizes, small = settle(sizes)
    lone = sizes.where("_n = 1").select(F.col(stratum).alias("_lone"), "_flag", F.col("_l1").alias("_a"), F.col("_l2").alias("_b"))
    multi = sizes.where("_n > 1")
    dist = F.abs(F.col("_l1") - F.col("_a")) + F.abs(F.col("_l2") - F.col("_b"))
    moved = lone.join(multi, "_flag", "inner").groupBy("_lone").agg(
        F.min_by(F.struct(F.col(stratum).alias("s"), F.col("_n").alias("n")), F.struct(dist, F.col(stratum))).alias("_to")
    )
    mapping = sizes.join(moved, sizes[stratum] == moved["_lone"], "left").select(
        stratum, F.coalesce("_to.s", stratum).alias("_new"), F.coalesce("_to.n", "_n").alias("fpc"))
    return join_small(df, mapping, [stratum]).withColumn(stratum, F.col("_new")).drop("_new")


def merge_empty_strata(df: DataFrame, stratum: str, r: str = "R") -> DataFrame:
    """A stratum without validated rows joins the preceding one that has some (else the next)."""
    t = df.groupBy(stratum).agg(F.sum(F.col(r).cast("bigint")).alias("_r"))
    back = Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(stratum).rowsBetween(0, Window.unboundedFollowing)
    filled = F.when(F.col("_r") > 0, F.col(stratum))
    mapping = settle(t)[0].select(stratum, F.coalesce(
        F.last(filled, ignorenulls=True).over(back), F.first(filled, ignorenulls=True).over(ahead), F.col(stratum)).alias("_new"))
    return join_small(df, mapping, [stratum]).withColumn(stratum, F.col("_new")).drop("_new")
