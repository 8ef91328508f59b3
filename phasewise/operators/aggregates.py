"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasewise.operators.order import running_sums
from phasewise.session import join_small


def crosstab(df: DataFrame, a: str, b: str | None = None) -> DataFrame:
    """Counts and overall proportions of one or two columns."""
    keys = [a] if b is None else [a, b]
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select(*keys, "n", (F.col("n") / F.col("_total")).alias("share"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows on the diagonal."""
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def stratum_moments(df: DataFrame, stratum: str | Sequence[str], y: str) -> DataFrame:
    """Size, mean and sample variance per stratum; a lone row has variance 0."""
    keys = [stratum] if isinstance(stratum, str) else list(stratum)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("variance")
    )


def collapse_entity(df: DataFrame, key: str, mean_cols: Sequence[str], first_cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Many rows per subject to one: NULL-skipping means, first value of attributes."""
    rank = F.struct(*order)
    return df.groupBy(key).agg(
        *[F.avg(c).alias(c) for c in mean_cols], *[F.min_by(c, rank).alias(c) for c in first_cols]
    )


def pivot_first(df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Long results to wide: first non-null value per id and name."""
    rank = F.struct(*order)
    return df.groupBy(*ids).agg(*[
        F.min_by(value, F.when((F.col(name) == n) & F.col(value).isNotNull(), rank)).alias(n) for n in names
    ])


def pairwise_covariance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Covariance on pairwise complete rows, long form (row, col, value), one pass."""
    aggs, names = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(F.covar_samp(F.col(a), F.col(b)).alias(f"c{len(names)}"))
            names.append((a, b))
    wide = df.agg(*aggs)
    parts = []
    for i, (a, b) in enumerate(names):
        parts.append(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"c{i}").alias("value")))
        if a != b:
            parts.append(F.struct(F.lit(b).alias("row"), F.lit(a).alias("col"), F.col(f"c{i}").alias("value")))
    return wide.select(F.explode(F.array(*parts)).alias("e")).select("e.*")


def nearest_psd(matrix: np.ndarray, tol: float = 1e-8) -> np.ndarray:
    """The matrix itself if no eigenvalue lies below -tol, else eigenvalues raised to ``tol`` and symmetrised (p x p, driver side)."""
    vals, vecs = np.linalg.eigh((matrix + matrix.T) / 2)
    if vals.min() >= -tol:
        return matrix
    raised = (vecs * np.maximum(vals, tol)) @ vecs.T
    return (raised + raised.T) / 2


def repaired_covariance(df: DataFrame, cols: Sequence[str], tol: float = 1e-8) -> DataFrame:
    """``pairwise_covariance`` (row, col, value) made positive semi-definite: pairwise complete rows need not agree.

    One pass over the rows; the p x p matrix is repaired on the driver. A pair without two common rows has
    covariance zero there.
    """
    place = {c: i for i, c in enumerate(cols)}
    matrix = np.zeros((len(cols), len(cols)))
    for r in pairwise_covariance(df, cols).collect():
        matrix[place[r["row"]], place[r["col"]]] = r["value"] if r["value"] is not None else 0.0
    fixed = nearest_psd(matrix, tol)
    rows = [(a, b, float(fixed[place[a], place[b]])) for a in cols for b in cols]
    return df.sparkSession.createDataFrame(rows, "row string, col string, value double")


def error_matrix(df: DataFrame, p1: str, p2: str, direction: str = "p1_given_p2", smooth: bool = False) -> DataFrame:
    """Misclassification table. ``p2_given_p1`` may add one to every cell of the level union."""
    given, out = (p2, p1) if direction == "p1_given_p2" else (p1, p2)
    pairs = df.where(F.col(p1).isNotNull() & F.col(p2).isNotNull())
    counts = pairs.groupBy(F.col(given).cast("string").alias("given"), F.col(out).cast("string").alias("level")).agg(
        F.count("*").alias("n")
    )
    if smooth:
        levels = counts.select(F.explode(F.array("given", "level")).alias("l")).agg(F.array_sort(F.collect_set("l")).alias("ls"))
        grid = levels.select(F.explode("ls").alias("given"), "ls").select("given", F.explode("ls").alias("level"))
        counts = grid.join(counts, ["given", "level"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    w = Window.partitionBy("given")
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(w))


def unpivot_terms(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(cols), "term", "estimate")


def safe_corr(a: str, b: str) -> str:
    """SQL for Pearson correlation on pairwise complete rows; NULL when a side is constant."""
    sa = f"stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END)"
    sb = f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END)"
    return f"(covar_pop({a}, {b}) / nullif({sa} * {sb}, 0D))"


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation and share of differing values."""
    return df.agg(
        F.expr(safe_corr(f"`{a}`", f"`{b}`")).alias("correlation"), F.avg((F.col(a) != F.col(b)).cast("double")).alias("mismatch")
    )


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols
    ])).alias("e")).select("e.*")
    return long.where(F.col("level").isNotNull()).groupBy("column", "level").agg(F.count("*").alias("n"))


def category_profile(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Per column and level: count, whether most frequent (ties: smallest), pair-union membership.

    Levels seen only in the partner column appear with n = 0.
    """
    counts = level_counts(df, cols)
    partner = {}
    for a, b in pairs:
        partner[a], partner[b] = b, a
    if partner:
        lookup = F.create_map(*[F.lit(x) for kv in partner.items() for x in kv])
        other = counts.select(lookup[F.col("column")].alias("column"), "level", F.lit(0).cast("bigint").alias("n"))
        counts = counts.unionByName(other.where(F.col("column").isNotNull())).groupBy("column", "level").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "level")
    return counts.withColumn("is_mode", (F.row_number().over(w) == 1) & (F.col("n") > 0))


def ecdf_midrank(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with (rows below + half the ties) / n."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    out = running_sums(counts, [column], {"through": "n"}, by)
    total = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    # Without groups the total is a single row.
    joined = join_small(out, total, list(by), "inner") if by else out.join(F.broadcast(total))
    return joined.select(*by, column, ((F.col("through") - F.lit(0.5) * F.col("n")) / F.col("_total")).alias("midrank"))


def box_summary(df: DataFrame, column: str, by: Sequence[str], probs: Mapping[str, float] | None = None) -> DataFrame:
    """Five-number summary per group."""
    from phasewise.operators.order import exact_quantiles

    # Names and probabilities of the five numbers.
    probs = probs or {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}
    q = exact_quantiles(df, column, list(probs.values()), by)
    return q.groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in probs.items()
    ])


def first_value(column: str, order: Column) -> Column:
    """Value at the first minimum of ``order``."""
    return F.min_by(column, order)
