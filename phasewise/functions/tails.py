"""Student t and normal quantiles in numpy, for result rows only (no scipy here)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from phasewise.functions.scalar import AS241, CODY

_NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * _incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    return 1.0 - tail if t >= 0 else tail


def t_ppf(p: float, df: float) -> float:
    """Student t quantile by bisection; normal for infinite degrees of freedom."""
    if df is None or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(df) or df > 1e7:
        return _NORMAL.inv_cdf(p)
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    lo, hi = 0.0, 2.0
    while t_cdf(hi, df) < p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid == lo or mid == hi:
            break
        if t_cdf(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def t_ppf_array(p: float, df: np.ndarray) -> np.ndarray:
    cache: dict[float, float] = {}
    out = np.empty(len(df))
    for i, d in enumerate(np.asarray(df, dtype=float)):
        if d not in cache:
            cache[d] = t_ppf(p, d)
        out[i] = cache[d]
    return out


def two_sided_p(stat: np.ndarray, df: np.ndarray | None = None) -> np.ndarray:
    if df is None:
        return np.array([math.erfc(abs(s) / math.sqrt(2.0)) for s in stat])
    return np.array([2.0 * t_cdf(-abs(s), d) for s, d in zip(stat, df)])


def _horner(coefs, r):
    out = np.full_like(r, coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * r + c
    return out


def normal_cdf_array(x: np.ndarray) -> np.ndarray:
    """Normal distribution function for Arrow batches (same ranges as the Column version)."""
    z = np.asarray(x, dtype=float) * math.sqrt(0.5)
    y = np.abs(z)

    def ratio(num, den, r):
        return _horner((*reversed(num[:-1]), num[-1]), r) / _horner((*reversed(den), 1.0), r)

    with np.errstate(all="ignore"):
        centre = 0.5 * (1.0 + z * ratio(CODY["a"], CODY["b"], z * z))
        mid = np.exp(-y * y) * ratio(CODY["c"], CODY["d"], y)
        inv = 1.0 / (y * y)
        far = np.exp(-y * y) / y * (1.0 / math.sqrt(math.pi) - inv * ratio(CODY["p"], CODY["q"], inv))
        tail = 0.5 * np.where(y <= 4.0, mid, far)
    return np.where(y <= 0.46875, centre, np.where(z > 0, 1.0 - tail, tail))


def normal_ppf_array(p: np.ndarray) -> np.ndarray:
    """Normal quantile for Arrow batches."""
    p = np.asarray(p, dtype=float)
    q = p - 0.5
    with np.errstate(all="ignore"):
        r = 0.180625 - q * q
        mid = q * _horner(AS241["a"], r) / _horner(AS241["b"], r)
        t = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
        near = _horner(AS241["c"], t - 1.6) / _horner(AS241["d"], t - 1.6)
        far = _horner(AS241["e"], t - 5.0) / _horner(AS241["f"], t - 5.0)
        side = np.where(t <= 5.0, near, far) * np.sign(q)
    return np.where(np.abs(q) <= 0.425, mid, side)
