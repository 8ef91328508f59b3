"""Normal regression corrected for outcome-dependent selection in bins of the outcome.

Validated rows were chosen with probability ``alloc[j]`` when the outcome fell in bin j, so the
likelihood of a validated row is f(y|x) pi(y) / integral of f pi.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.functions.keyed import chisq_value, normal, normal_value, uniform
from phasewise.functions.tails import normal_cdf_array, normal_ppf_array
from phasewise.imputation.draws import RIDGE, cholesky
from phasewise.models import linear
from phasewise.models.linear import as_terms
from phasewise.models.partial import sum_vectors

MAX_STEPS = 100
TOLERANCE = 1e-10


def _phi(z):
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


@dataclass
class WeightedLikelihoodFit:
    terms: dict[str, Column]
    beta: np.ndarray
    log_sigma: float
    cov: np.ndarray
    splits: tuple[float, ...]
    alloc: tuple[float, ...]
    rss: float
    n: int

    @property
    def sigma(self) -> float:
        return math.exp(self.log_sigma)


def likelihood_sums(x, y, beta, log_sigma, splits, alloc):
    """Log-likelihood, gradient and curvature in (beta, log sigma), with the residual sum of squares."""
    p = x.shape[1]
    s = math.exp(log_sigma)
    mu = x @ beta
    r = (y - mu) / s
    jumps = np.asarray(alloc[:-1]) - np.asarray(alloc[1:])
    z = (np.asarray(splits)[None, :] - mu[:, None]) / s
    f, cdf = _phi(z), normal_cdf_array(z)
    d = alloc[-1] + cdf @ jumps
    d_mu, d_s = -(f @ jumps) / s, -(f * z) @ jumps
    d_mm = -(f * z) @ jumps / s ** 2
    d_ms = (f * (1 - z * z)) @ jumps / s
    d_ss = (z * f * (1 - z * z)) @ jumps
    ll = (-0.5 * r * r - log_sigma - 0.5 * math.log(2 * math.pi) - np.log(d)).sum()
    g_mu, g_s = r / s - d_mu / d, r * r - 1 - d_s / d
    h_mm = -1 / s ** 2 - d_mm / d + (d_mu / d) ** 2
    h_ms = -2 * r / s - d_ms / d + d_mu * d_s / d ** 2
    h_ss = -2 * r * r - d_ss / d + (d_s / d) ** 2
    hess = np.zeros((p + 1, p + 1))
    hess[:p, :p] = (x * h_mm[:, None]).T @ x
    hess[:p, p] = hess[p, :p] = x.T @ h_ms
    hess[p, p] = h_ss.sum()
    return np.concatenate([[ll], x.T @ g_mu, [g_s.sum()], hess.ravel(), [((y - mu) ** 2).sum(), len(y)]])


def fit_weighted_likelihood(df: DataFrame, y: str, terms: Mapping[str, Column] | Sequence[str], splits: Sequence[float], alloc: Sequence[float]) -> WeightedLikelihoodFit:
    """Newton with a likelihood check; every step is one pass of partial sums over validated rows."""
    return fit_weighted_likelihoods(df.withColumn("_all", F.lit(0)), y, terms, splits, alloc, ["_all"])[(0,)]


def fit_weighted_likelihoods(
    df: DataFrame, y: str, terms: Mapping[str, Column] | Sequence[str], splits: Sequence[float], alloc: Sequence[float], by: Sequence[str] = ("imp_id",),
) -> dict[tuple, WeightedLikelihoodFit]:
    """The same fit for every group at once (imputations: few), keyed by the group's values.

    One pass a step serves all groups: each halves its own step until its likelihood rises, and is left
    out of the sums once it stands still. The driver holds p + 1 parameters a group.
    """
    by = list(by)
    terms = as_terms(terms)
    p = len(terms)
    xs = [f"x{i}" for i in range(p)]
    frame = df.select(*by, F.col(y).cast("double").alias("_y"), *[c.alias(x) for x, c in zip(xs, terms.values())]).dropna().persist()
    splits, alloc = tuple(float(v) for v in splits), tuple(float(v) for v in alloc)
    theta = {}
    # the start reads the kept rows: ``df`` may be a join of a chain's tables, which each scan shuffles anew
    for r in linear.fit_lm(frame, "_y", {t: F.col(x) for x, t in zip(xs, terms)}, by=by, intercept=False).table.collect():
        theta[tuple(r[c] for c in by)] = np.concatenate([np.array(r["beta"]), [0.5 * math.log(max(r["rss"] / r["n"], 1e-12))]])

    def total(at: dict) -> dict:
        def batch(group, g):
            if group not in at:
                return np.zeros(1)
            now = at[group]
            return likelihood_sums(g[xs].to_numpy(float), g["_y"].to_numpy(float), now[:p], now[p], splits, alloc)

        return {g: v for g, v in sum_vectors(frame, by, batch).items() if g in at}

    value = total(theta)
    moving = set(theta)
    for _ in range(MAX_STEPS):
        step = {}
        for g in moving:
            v = value[g]
            grad, hess = v[1:p + 2], v[p + 2:-2].reshape(p + 1, p + 1)
            vals, vecs = np.linalg.eigh(-(hess + hess.T) / 2)
            step[g] = vecs @ ((vecs.T @ grad) / np.maximum(np.abs(vals), 1e-8 * np.abs(vals).max()))
        scale, open_, new = 1.0, set(moving), {}
        while open_ and scale > 1e-6:
            tried = total({g: theta[g] + scale * step[g] for g in open_})
            for g, v in tried.items():
                new[g] = (theta[g] + scale * step[g], scale, v)
            open_ = {g for g in open_ if not tried[g][0] >= value[g][0] - 1e-12 * abs(value[g][0])}
            scale /= 2
        for g, (at, taken, v) in new.items():
            gain = v[0] - value[g][0]
            theta[g], value[g] = at, v
            if np.abs(taken * step[g]).max() < TOLERANCE or 0 <= gain < 1e-13 * abs(v[0]):
                moving.discard(g)
        if not moving:
            break
    frame.unpersist()
    out = {}
    for g, v in value.items():
        hess = -v[p + 2:-2].reshape(p + 1, p + 1)
        cov = np.linalg.pinv(hess + RIDGE * np.diag(np.diag(hess)))
        out[g] = WeightedLikelihoodFit(terms, theta[g][:p], float(theta[g][p]), cov[:p, :p], splits, alloc, float(v[-2]), int(v[-1]))
    return out


def _parameter_draw(fit: WeightedLikelihoodFit, seed, tag: str, imp: int) -> tuple[np.ndarray, float]:
    """Coefficients by the Cholesky root and keyed normals, residual SD by a keyed chi-square."""
    z = np.array([normal_value(seed, f"{tag}|b{j}", imp) for j in range(len(fit.beta))])
    spread = chisq_value(max(fit.n - len(fit.beta), 1), seed, f"{tag}|s", imp)
    return fit.beta + cholesky(fit.cov) @ z, math.sqrt(fit.rss / spread)


def _bins(mu, sigma, splits):
    z = (np.asarray(splits)[None, :] - mu[:, None]) / sigma
    cdf = np.hstack([np.zeros((len(mu), 1)), normal_cdf_array(z), np.ones((len(mu), 1))])
    return z, cdf


def _unselected_mean(mu, sigma, splits, alloc):
    """Mean of y among rows not selected: truncated-normal pieces weighted by 1 - alloc."""
    z, cdf = _bins(mu, sigma, splits)
    f = np.hstack([np.zeros((len(mu), 1)), _phi(z), np.zeros((len(mu), 1))])
    keep = 1 - np.asarray(alloc)
    prob = np.diff(cdf, axis=1)
    piece = mu[:, None] * prob - sigma * np.diff(f, axis=1)
    return (piece @ keep) / (prob @ keep)


def _unselected_draw(mu, u1, u2, sigma, splits, alloc):
    """Exact draw from f(y)(1 - pi(y)): choose the bin, then invert the distribution inside it.

    This is the law that accept-reject with (1 - pi(y)) / max(1 - pi) converges to, without attempts.
    """
    _, cdf = _bins(mu, sigma, splits)
    mass = np.diff(cdf, axis=1) * (1 - np.asarray(alloc))
    cum = np.cumsum(mass, axis=1) / mass.sum(axis=1, keepdims=True)
    j = np.minimum((cum <= u1[:, None]).sum(axis=1), len(alloc) - 1)
    rows = np.arange(len(mu))
    lo, hi = cdf[rows, j], cdf[rows, j + 1]
    return mu + np.ravel(sigma) * normal_ppf_array(np.clip(lo + u2 * (hi - lo), 1e-300, 1 - 1e-16))


def draw_weighted_likelihood(
    df: DataFrame, fit: WeightedLikelihoodFit | Mapping[int, WeightedLikelihoodFit], target: str, missing: str, key: str, seed, tag: str, m: int,
    by: str = "sampling", acceptance: str = "unselected",
) -> DataFrame:
    """Fill rows flagged ``missing`` on a stacked table, by one fit or by the fit of each imputation.

    ``sampling`` draws from the law of unselected rows; ``integration`` takes its mean plus noise. With
    ``acceptance="as_published"`` a proposal y is taken with probability (1 - pi(y)) / (1 - max(alloc)), which is never
    below 1: every normal proposal stays, so rows are drawn from the uncorrected normal law.
    """
    if by not in ("sampling", "integration") or acceptance not in ("unselected", "as_published"):
        raise ValueError(f"unknown draw: {by}, {acceptance}")
    fits = dict(fit) if isinstance(fit, Mapping) else {i: fit for i in range(1, m + 1)}
    params = {i: _parameter_draw(f, seed, f"{tag}|{target}", i) for i, f in fits.items()}
    one = next(iter(fits.values()))
    splits, alloc = one.splits, one.alloc
    of_imp = lambda values: F.element_at(F.create_map(*[v for i, c in values.items() for v in (F.lit(i), c)]), F.col("imp_id"))
    d = df.withColumn("_beta", of_imp({i: F.array(*[F.lit(float(q)) for q in b]) for i, (b, _) in params.items()}))
    d = d.withColumn("_mu", linear.eta(one.terms)).withColumn("_sigma", of_imp({i: F.lit(float(f.sigma)) for i, f in fits.items()}))

    if by == "integration":
        @F.pandas_udf("double")
        def mean(mu: pd.Series, sigma: pd.Series) -> pd.Series:
            return pd.Series(_unselected_mean(mu.to_numpy(float), sigma.to_numpy(float)[:, None], splits, alloc))

        noise = of_imp({i: F.lit(float(s)) for i, (_, s) in params.items()}) * normal(seed, f"{tag}|{target}|e", "imp_id", key)
        value = mean("_mu", "_sigma") + noise
    elif acceptance == "as_published":
        value = F.col("_mu") + F.col("_sigma") * normal(seed, f"{tag}|{target}|e", "imp_id", key)
    else:
        @F.pandas_udf("double")
        def drawn(mu: pd.Series, sigma: pd.Series, u1: pd.Series, u2: pd.Series) -> pd.Series:
            return pd.Series(_unselected_draw(mu.to_numpy(float), u1.to_numpy(float), u2.to_numpy(float), sigma.to_numpy(float)[:, None], splits, alloc))

        value = drawn("_mu", "_sigma", uniform(seed, f"{tag}|{target}|bin", "imp_id", key), uniform(seed, f"{tag}|{target}|in", "imp_id", key))
    return d.withColumn("_new", value).withColumn(target, F.when(F.col(missing), F.col("_new")).otherwise(F.col(target))).drop("_beta", "_mu", "_sigma", "_new")


def draw_in_chain(df: DataFrame, target: str, terms, missing: str, key: str, seed, tag: str, splits: Sequence[float], alloc: Sequence[float],
                  by: str = "sampling", acceptance: str = "unselected") -> DataFrame:
    """One step of chained equations: a fit for every imputation on its rows with a known target, then the draw."""
    fits = fit_weighted_likelihoods(df.where(~F.col(missing)), target, terms, splits, alloc, ["imp_id"])
    return draw_weighted_likelihood(df, {g[0]: f for g, f in fits.items()}, target, missing, key, seed, tag, len(fits), by, acceptance)


def impute_weighted_likelihood(df: DataFrame, target: str, terms, splits, alloc, key: str, m: int, seed, by: str = "sampling", acceptance: str = "unselected") -> DataFrame:
    """Fit on validated rows and fill the rest, m times."""
    from phasewise.imputation.draws import stack_copies

    fit = fit_weighted_likelihood(df.where(F.col(target).isNotNull()), target, terms, splits, alloc)
    flag = f"_miss_{target}"
    d = stack_copies(df.withColumn(flag, F.col(target).isNull()), m)
    return draw_weighted_likelihood(d, fit, target, flag, key, seed, "weighted_likelihood", m, by, acceptance).drop(flag)
