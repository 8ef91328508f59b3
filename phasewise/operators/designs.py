"""Second-phase sampling designs. Each returns the cohort with ``R`` and ``W`` (and its score).

Selection is by exact rank cuts, so no cohort or stratum is ever sorted in one task. With
``by`` (replicates) every design runs for all groups in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.functions.keyed import uniform
from phasewise.models import linear
from phasewise.operators.allocation import balanced_quota, exact_allocation
from phasewise.operators.columns import mask_phase2, quantile_bins
from phasewise.operators.order import at_or_below, attach_cuts, lowest, rank_cuts
from phasewise.session import join_small, settle


def _tie_key(df: DataFrame, key: str) -> Column:
    """Numeric tie-breaker: the key itself, or a hash of a text key."""
    return F.xxhash64(key) if df.schema[key].dataType.simpleString() == "string" else F.col(key)


def _finish(df: DataFrame, chosen: Column, weight: Column, masked: Sequence[str]) -> DataFrame:
    out = df.withColumns({"R": chosen.cast("int"), "W": weight.cast("double")})
    return mask_phase2(out, masked) if masked else out


def srs(df: DataFrame, key: str, n: int, seed, masked: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Simple random sample of n rows per group; weight 1."""
    d = df.withColumns({"_u": uniform(seed, "srs", *by, key), "_k": _tie_key(df, key)})
    quota = d.groupBy(*by).agg(F.least(F.lit(n), F.count("*")).alias("_q"))
    d = lowest(d, "_u", "_k", quota, "_q", by)
    return _finish(d, F.col("chosen"), F.lit(1.0), masked).drop("chosen", "_u", "_k")


def two_tail(df: DataFrame, score: str, key: str, n: int, masked: Sequence[str] = (), by: Sequence[str] = (), only: Column | None = None) -> DataFrame:
    """Lowest n//2 and highest n//2 rows in the order (score, key); ``only`` restricts the pool."""
    d = df.withColumn("_k", _tie_key(df, key))
    pool = F.col(score).isNotNull() & (only if only is not None else F.lit(True))
    d = d.withColumn("_pool", pool)
    inside = d.where("_pool")
    half = F.least(F.lit(n // 2), F.floor(F.count("*") / 2))
    wants = inside.groupBy(*by).agg(half.alias("_lo"), (F.count("*") - half).alias("_hi"))
    cuts = rank_cuts(inside, score, "_k", wants, ["_lo", "_hi"], by)
    d = attach_cuts(d, cuts, by)
    low = at_or_below(F.col(score), F.col("_k"), 0)
    high = ~at_or_below(F.col(score), F.col("_k"), 1)
    return _finish(d, F.col("_pool") & (low | high), F.lit(1.0), masked).drop("_k", "_pool", "_cv0", "_ck0", "_cv1", "_ck1")


def ods_tail(df: DataFrame, y: str, key: str, n: int, masked: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Extreme outcomes, half in each tail."""
    return two_tail(df, y, key, n, masked, by)


def residual_sampling(df: DataFrame, y: str, terms, key: str, n: int, masked: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Tails of residuals of an outcome model that includes the surrogates; adds ``rs``."""
    fit = linear.fit_lm(df, y, terms, by=by)
    return two_tail(linear.residuals(fit, df, "rs"), "rs", key, n, masked, by)


def score_sampling(df: DataFrame, y: str, terms, surrogate: str, key: str, n: int, masked: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Tails of residual x surrogate; adds ``score``."""
    fit = linear.fit_lm(df, y, terms, by=by)
    d = linear.residuals(fit, df, "_e").withColumn("score", F.col("_e") * F.col(surrogate)).drop("_e")
    return two_tail(d, "score", key, n, masked, by)


def weighted_residual_sampling(
    df: DataFrame, y: str, terms, target: str, pilot_terms, key: str, n: int, seed,
    pilot_share: float = 0.1, masked: Sequence[str] = (),
) -> DataFrame:
    """Random pilot; its residual spread scales the outcome residuals of the rest; adds ``wrs``."""
    n_pilot = round(n * pilot_share)
    d = srs(df, key, n_pilot, seed).withColumnRenamed("R", "_pilot").drop("W")
    pilot_fit = linear.fit_lm(d.where("_pilot = 1"), target, pilot_terms)
    rest_fit = linear.fit_lm(d.where("_pilot = 0"), y, terms)
    stat = pilot_fit.table.first()
    # The residuals of a fit with intercept have mean zero, so their SD needs only the RSS.
    sd = (stat["rss"] / max(stat["n"] - 1, 1)) ** 0.5
    d = linear.residuals(pilot_fit, d, "_ep")
    d = linear.residuals(rest_fit, d, "_er")
    d = d.withColumn("wrs", F.when(F.col("_pilot") == 1, F.col("_ep")).otherwise(F.col("_er") * F.lit(sd))).drop("_ep", "_er")
    d = two_tail(d, "wrs", key, n - n_pilot, only=F.col("_pilot") == 0)
    chosen = (F.col("R") == 1) | (F.col("_pilot") == 1)
    return _finish(d, chosen, F.lit(1.0), masked).drop("_pilot")


def draw_per_stratum(df: DataFrame, stratum: str, quota: DataFrame, key: str, seed, by: Sequence[str] = (), n_col: str = "alloc") -> DataFrame:
    """Without replacement, ``n_col`` rows per stratum; adds ``R`` and ``W`` = size / drawn.

    ``quota`` has the stratum, its ``size`` and ``n_col``.
    """
    keys = [*by, stratum]
    q, _ = settle(quota.select(*keys, "size", F.least(F.col(n_col), F.col("size")).alias("_q")))
    d = df.withColumns({"_u": uniform(seed, "draw", *keys, key), "_k": _tie_key(df, key)})
    d = lowest(d, "_u", "_k", q.where("_q > 0"), "_q", keys)
    # A stratum without draws has no validated row; its size over zero is an infinite weight.
    w = F.when(F.col("_q") > 0, F.col("size") / F.nullif(F.col("_q"), F.lit(0))).otherwise(F.lit(float("inf")))
    d = join_small(d, q.select(*keys, w.alias("_w")), keys)
    return _finish(d, F.col("chosen"), F.col("_w"), ()).drop("chosen", "_u", "_k", "_w")


def neyman(df: DataFrame, stratum: str, target: str, key: str, n: int, seed, cap: bool = False, masked: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Optimal allocation on the spread of ``target`` within given strata."""
    alloc = exact_allocation(df, stratum, target, n, cap, by)
    out = draw_per_stratum(df, stratum, alloc, key, seed, by)
    return mask_phase2(out, masked) if masked else out


def neyman_ods(df: DataFrame, y: str, surrogate: str, key: str, n: int, seed, masked: Sequence[str] = ()) -> DataFrame:
    """Strata from the outcome (.19/.81); allocation on the surrogate's spread."""
    return neyman(quantile_bins(df, y), "outcome_strata", surrogate, key, n, seed, masked=masked)


def neyman_inf(df: DataFrame, y: str, terms, coefficient: str, key: str, n: int, seed, strata_from: str | None = None,
               family: str = "gaussian", masked: Sequence[str] = ()) -> DataFrame:
    """Same strata; allocation on the influence of one named coefficient; adds ``inf``."""
    fit = linear.fit_glm(df, y, terms, family)
    d = linear.dfbeta(fit, df, [coefficient], "_db_").withColumnRenamed(f"_db_{coefficient}", "inf")
    return neyman(quantile_bins(d, strata_from or y), "outcome_strata", "inf", key, n, seed, masked=masked)


def neyman_ods_unval(df: DataFrame, y: str, surrogate: str, key: str, n: int, seed, masked: Sequence[str] = ()) -> DataFrame:
    """Strata from the surrogate; allocation on the outcome."""
    return neyman(quantile_bins(df, surrogate), "outcome_strata", y, key, n, seed, masked=masked)


def neyman_inf_unval(df: DataFrame, y: str, terms, coefficient: str, surrogate: str, key: str, n: int, seed,
                     family: str = "gaussian", masked: Sequence[str] = ()) -> DataFrame:
    """Strata from the surrogate; allocation on influence."""
    return neyman_inf(df, y, terms, coefficient, key, n, seed, surrogate, family, masked)


def balanced(df: DataFrame, stratum: str, key: str, n: int, seed, masked: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Equal numbers per stratum, remainder over open strata; W = size / drawn."""
    out = draw_per_stratum(df, stratum, balanced_quota(df, stratum, n, by), key, seed, by)
    return mask_phase2(out, masked) if masked else out
