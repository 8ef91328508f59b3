"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def expit(x: Column) -> Column:
    """Logistic function; never overflows because exp only sees non-positive input."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


# The two constant sets in use, unit factor (umol/L to mg/dL) and cap.
EGFR_CONSTANTS = {
    "clean": {"scale": 142.0, "power": -1.200, "age_base": 0.9938, "female": 1.012, "digits": 0},
    "noisy": {"scale": 141.0, "power": -1.209, "age_base": 0.993, "female": 1.018, "digits": None},
}
EGFR_KAPPA = {"female": 0.7, "male": 0.9}
EGFR_ALPHA = {"female": -0.329, "male": -0.411}
EGFR_UMOL_PER_MG = 88.4
EGFR_CAP = 140.0


def egfr(creatinine: Column, age: Column, female: Column, version: str = "clean") -> Column:
    """Estimated kidney function from creatinine (umol/L), age in years and sex."""
    c = EGFR_CONSTANTS[version]

    def by_sex(values):
        return F.when(female, F.lit(values["female"])).otherwise(F.lit(values["male"]))

    ratio = creatinine / F.lit(EGFR_UMOL_PER_MG) / by_sex(EGFR_KAPPA)
    value = (
        F.lit(c["scale"])
        * F.pow(F.least(ratio, F.lit(1.0)), by_sex(EGFR_ALPHA))
        * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(c["power"]))
        * F.pow(F.lit(c["age_base"]), age)
        * by_sex({"female": c["female"], "male": 1.0})
    )
    if c["digits"] is not None:
        value = F.round(value, c["digits"])
    return F.least(value, F.lit(EGFR_CAP))


def soft_range(x: Column, mean, sd, target_mean: float, target_sd: float, lo: float, hi: float) -> Column:
    """Squeeze a value smoothly into (lo, hi).

    ``mean``/``sd`` standardise the input; the curve passes through ``target_mean`` at
    z = 0 with a slope that gives about ``target_sd`` there.
    """
    width = float(hi - lo)
    share = min(max((target_mean - lo) / width, 0.001), 0.999)
    offset = math.log(share / (1.0 - share))
    slope = target_sd / (width * share * (1.0 - share))
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    s = sd if isinstance(sd, Column) else F.lit(float(sd))
    return F.lit(float(lo)) + F.lit(width) * expit(F.lit(offset) + F.lit(slope) * (x - m) / s)


def soft_max2(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def bmi(weight_kg: Column, height_m: Column) -> Column:
    return weight_kg / (height_m * height_m)


def hazard_ratio(beta: Column, jump) -> Column:
    """Ratio for a change of ``jump`` units: exp(beta * jump)."""
    j = jump if isinstance(jump, Column) else F.lit(float(jump))
    return F.exp(beta * j)


def norm_pdf(x: Column) -> Column:
    return F.exp(F.lit(-0.5) * x * x) / F.lit(math.sqrt(2 * math.pi))


# Cody's rational approximations of the error function (three ranges).
CODY = {
    "a": (3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3,
          1.85777706184603153e-1),
    "b": (2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
    "c": (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
          8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
          2.15311535474403846e-8),
    "d": (1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
          3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
    "p": (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2,
          6.58749161529837803e-4, 1.63153871373020978e-2),
    "q": (2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2,
          2.33520497626869185e-3),
}


def _ratio(num, den, r):
    """num[-1] leads the numerator, 1 leads the denominator."""
    return _poly((*reversed(num[:-1]), num[-1]), r) / _poly((*reversed(den), 1.0), r)


def norm_cdf(x: Column) -> Column:
    """Normal distribution function to about 1e-15 (through erf / erfc)."""
    z = x * F.lit(math.sqrt(0.5))
    y = F.abs(z)
    small = z * _ratio(CODY["a"], CODY["b"], z * z)
    mid = F.exp(-y * y) * _ratio(CODY["c"], CODY["d"], y)
    inv = F.lit(1.0) / (y * y)
    far = F.exp(-y * y) / y * (F.lit(1.0 / math.sqrt(math.pi)) - inv * _ratio(CODY["p"], CODY["q"], inv))
    tail = F.lit(0.5) * F.when(y <= 4.0, mid).otherwise(far)
    return F.when(y <= 0.46875, F.lit(0.5) * (F.lit(1.0) + small)).when(z > 0, F.lit(1.0) - tail).otherwise(tail)


# Wichura's AS 241 rational approximation of the normal quantile (PPND16).
AS241 = {
    "a": (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
          1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
          3.3430575583588128105e4, 2.5090809287301226727e3),
    "b": (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
          2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
          5.2264952788528545610e3),
    "c": (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
          3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
          2.27238449892691845833e-2, 7.74545014278341407640e-4),
    "d": (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
          1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
          1.05075007164441684324e-9),
    "e": (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
          2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
          2.71155556874348757815e-5, 2.01033439929228813265e-7),
    "f": (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
          2.04426310338993978564e-15),
}


def _poly(coefs, r):
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * r + F.lit(c)
    return out


def norm_ppf(p: Column) -> Column:
    """Normal quantile (double-precision rational approximation)."""
    q = p - F.lit(0.5)
    r0 = F.lit(0.180625) - q * q
    mid = q * _poly(AS241["a"], r0) / _poly(AS241["b"], r0)
    tail = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    r1 = tail - F.lit(1.6)
    r2 = tail - F.lit(5.0)
    side = F.when(
        tail <= 5.0, _poly(AS241["c"], r1) / _poly(AS241["d"], r1)
    ).otherwise(_poly(AS241["e"], r2) / _poly(AS241["f"], r2))
    return F.when(F.abs(q) <= 0.425, mid).when(q < 0, -side).otherwise(side)
