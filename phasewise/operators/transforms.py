"""Reversible column transforms: fit by aggregation, apply and invert row by row.

``fit`` returns an object with ``transform`` and ``inverse``. Parameters are a handful of
numbers per column, or at most ``MAX_KNOTS`` curve points.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.functions.tails import normal_cdf_array, normal_ppf_array
from phasewise.operators.aggregates import category_profile
from phasewise.operators.columns import Roles, level_codes
from phasewise.operators.order import running_sums, value_ranks
from phasewise.session import join_small

# Guards and grid sizes of the transforms.
EPSILON = 1e-6
QUANTILE_POINTS = 1_000
QUANTILE_CLIP = 1e-7
KDE_POINTS = 1_000
KDE_FLOOR = 1e-10
KDE_MARGIN = 0.1
MIXTURE_FLOOR = 1e-3
MIXTURE_STEPS = 100
MIXTURE_MAX = 5
MAX_KNOTS = 5_000


# ------------------------------------------------------------------ curves

def pchip_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the monotone cubic: weighted harmonic means inside, one-sided at the ends."""
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.array([s[0], s[0]])
    d = np.zeros(len(x))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = s[:-1] * s[1:] > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = (w1 + w2) / (w1 / s[:-1] + w2 / s[1:])
    d[1:-1] = np.where(same, mean, 0.0)
    for at, h0, h1, s0, s1 in ((0, h[0], h[1], s[0], s[1]), (-1, h[-1], h[-2], s[-1], s[-2])):
        v = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        if v * s0 <= 0:
            v = 0.0
        elif s0 * s1 <= 0 and abs(v) > 3 * abs(s0):
            v = 3 * s0
        d[at] = v
    return d


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic through (x, y), continued by its end pieces."""
    d = pchip_slopes(x, y)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    t = (at - x[i]) / h
    return (
        (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h * d[i]
        + t * t * (3 - 2 * t) * y[i + 1] + t * t * (t - 1) * h * d[i + 1]
    )


def _value(kind: str, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    if kind == "pchip":
        return pchip(x, y, at)
    if kind == "steps":
        # Average of the interpolation from both sides: flat quantile runs map to their middle.
        return 0.5 * (np.interp(at, x, y) - np.interp(-at, -x[::-1], -y[::-1]))
    return np.interp(at, x, y)


def _batches(fn, column: Column) -> Column:
    """Evaluate a vectorised function in Arrow batches; NULL stays NULL."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        a = v.to_numpy(dtype=float)
        ok = ~np.isnan(a)
        out = np.full(len(a), np.nan)
        out[ok] = fn(a[ok])
        return pd.Series(out).astype("Float64").where(ok)

    return run(column)


def _to_normal(m: dict, column: Column) -> Column:
    """x -> fitted uniform -> clipped -> normal score. The knots travel with the function."""
    kind, x, u, clip = m["kind"], m["x"], m["u"], m["clip"]
    return _batches(lambda a: normal_ppf_array(np.clip(_value(kind, x, u, a), clip, 1.0 - clip)), column)


def _from_normal(m: dict, column: Column) -> Column:
    kind, x, u = m["back"], m["x"], m["u"]
    return _batches(lambda z: _value(kind, u, x, np.clip(normal_cdf_array(z), u[0], u[-1])), column)


# ------------------------------------------------------------------ base

class Fitted:
    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def inverse(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


def _numeric(df: DataFrame, roles: Roles) -> list[str]:
    return [c for c in roles.numeric if c in df.columns]


# ------------------------------------------------------------------ numeric transforms

@dataclass
class LogShift(Fitted):
    """log1p(x + shift); a pair shares one shift from its joint minimum."""

    shifts: Mapping[str, float]

    @classmethod
    def fit(cls, df: DataFrame, roles: Roles) -> LogShift:
        cols = _numeric(df, roles)
        low = df.agg(*[F.min(c).alias(c) for c in cols]).first().asDict()
        for a, b in roles.numeric_pairs:
            joint = [v for v in (low.get(a), low.get(b)) if v is not None]
            if joint:
                low[a] = low[b] = min(joint)
        return cls({c: (abs(v) + 1.0 if v is not None and v <= 0 else 0.0) for c, v in low.items()})

    def transform(self, df):
        return df.withColumns({c: F.log1p(F.col(c) + F.lit(float(s))) for c, s in self.shifts.items() if c in df.columns})

    def inverse(self, df):
        return df.withColumns({c: F.expm1(F.col(c)) - F.lit(float(s)) for c, s in self.shifts.items() if c in df.columns})


@dataclass
class Residual(Fitted):
    """Numeric validated columns become surrogate minus validated; its own inverse."""

    pairs: Sequence[tuple[str, str]]

    @classmethod
    def fit(cls, df: DataFrame, roles: Roles) -> Residual:
        return cls(roles.numeric_pairs)

    def transform(self, df):
        return df.withColumns({b: F.col(a) - F.col(b) for a, b in self.pairs})

    inverse = transform


@dataclass
class Affine(Fitted):
    """(x - centre) / scale; NULL becomes ``null_value`` unless that is None."""

    params: Mapping[str, tuple[float, float]]
    null_value: float | None = 0.0

    def transform(self, df):
        out = {}
        for c, (m, s) in self.params.items():
            if c in df.columns:
                v = (F.col(c) - F.lit(float(m))) / F.lit(float(s))
                out[c] = v if self.null_value is None else F.coalesce(v, F.lit(self.null_value))
        return df.withColumns(out)

    def inverse(self, df):
        return df.withColumns({
            c: F.col(c) * F.lit(float(s)) + F.lit(float(m)) for c, (m, s) in self.params.items() if c in df.columns})


def _anchored(params: dict, roles: Roles, anchor: bool) -> dict:
    """With ``anchor`` a validated column reuses its surrogate's parameters."""
    if anchor:
        for a, b in roles.numeric_pairs:
            if a in params:
                params[b] = params[a]
    return params


def fit_zscore(df: DataFrame, roles: Roles, anchor: bool = False, null_value: float | None = 0.0) -> Affine:
    cols = _numeric(df, roles)
    r = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    params = {c: (r[f"m{i}"], r[f"s{i}"] + EPSILON) for i, c in enumerate(cols) if r[f"m{i}"] is not None}
    return Affine(_anchored(params, roles, anchor), null_value)


def fit_minmax(df: DataFrame, roles: Roles, variant: str = "epsilon", anchor: bool = False, null_value: float | None = None) -> Affine:
    """``epsilon``: (x-min)/(max-min+1e-6); ``margin``: (x-(min-1))/(max-min+1)."""
    cols = _numeric(df, roles)
    r = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(cols)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    params = {}
    for i, c in enumerate(cols):
        a, b = r[f"a{i}"], r[f"b{i}"]
        if a is not None:
            params[c] = (a, b - a + EPSILON) if variant == "epsilon" else (a - 1.0, b - a + 1.0)
    return Affine(_anchored(params, roles, anchor), null_value)


def quantile_grid(df: DataFrame, column: str, points: int = QUANTILE_POINTS) -> np.ndarray:
    """Exact quantiles on an even grid: ranks by a distributed prefix sum, then only grid rows return."""
    ranks = value_ranks(df, column)
    n = int(ranks.agg(F.max("through")).first()[0])
    q = min(n, points)
    if q == 1:
        return np.array([float(ranks.first()[column])])
    step = (n - 1) / (q - 1)
    # Grid point i needs the rows at zero-based ranks floor(i*step) and ceil(i*step).
    first, last = F.col("through") - F.col("n"), F.col("through") - 1
    near = F.sequence(
        F.greatest(F.floor(first / F.lit(step)) - 1, F.lit(0)).cast("int"),
        F.least(F.floor(last / F.lit(step)) + 2, F.lit(q - 1)).cast("int"))
    hits = ranks.select(F.col(column).cast("double").alias("v"), first.alias("a"), last.alias("b"), F.explode(near).alias("i"))
    pos = F.col("i") * F.lit(step)
    pos = F.when(F.col("i") == q - 1, F.lit(float(n - 1))).otherwise(pos)
    hits = hits.withColumn("pos", pos).withColumns({
        "lo": F.when(F.floor("pos").between(F.col("a"), F.col("b")), F.col("v")),
        "hi": F.when(F.ceil("pos").between(F.col("a"), F.col("b")), F.col("v"))})
    grid = hits.groupBy("i").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("pos").alias("pos")).toPandas().sort_values("i")
    frac = grid["pos"] - np.floor(grid["pos"])
    return (grid["lo"] + frac * (grid["hi"] - grid["lo"])).to_numpy(dtype=float)


@dataclass
class Curves(Fitted):
    """Column -> uniform by a fitted curve -> normal score, and back. Other columns: affine."""

    curves: Mapping[str, dict]
    affine: Affine | None = None
    null_value: float | None = 0.0

    def transform(self, df):
        out = self.affine.transform(df) if self.affine else df
        z = {c: _to_normal(m, F.col(c).cast("double")) for c, m in self.curves.items() if c in df.columns}
        out = out.withColumns(z)
        return out if self.null_value is None else out.withColumns({c: F.coalesce(F.col(c), F.lit(self.null_value)) for c in z})

    def inverse(self, df):
        out = df.withColumns({c: _from_normal(m, F.col(c)) for c, m in self.curves.items() if c in df.columns})
        return self.affine.inverse(out) if self.affine else out


def _fit_curves(df: DataFrame, roles: Roles, make, anchor: bool, cols: Sequence[str] | None = None) -> Curves:
    curves, plain = {}, []
    for c in cols or _numeric(df, roles):
        m = make(df, c)
        if m is None:
            plain.append(c)
        else:
            curves[c] = m
    if anchor:
        for a, b in roles.numeric_pairs:
            if a in curves:
                curves[b] = curves[a]
    affine = None
    if plain:
        r = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(plain)]).first()
        affine = Affine({c: (r[f"m{i}"] or 0.0, 1e-6 + EPSILON) for i, c in enumerate(plain)})
    return Curves(curves, affine)


def fit_quantile_normal(df: DataFrame, roles: Roles, anchor: bool = False, points: int = QUANTILE_POINTS) -> Curves:
    """Up to ``points`` quantiles, piecewise linear to uniform, then normal score."""

    def make(d, c):
        x = quantile_grid(d, c, points)
        if len(x) < 2:
            return None
        return {"kind": "steps", "back": "linear", "x": x, "u": np.linspace(0, 1, len(x)), "clip": QUANTILE_CLIP}

    return _fit_curves(df, roles, make, anchor)


def fit_ecdf_spline(df: DataFrame, roles: Roles, anchor: bool = False, knots: int = MAX_KNOTS) -> Curves:
    """Monotone cubic through the mid-rank distribution function, clipped, normal score.

    Every distinct value is a knot up to ``knots`` of them; beyond that, values evenly spaced
    in rank (the two extremes always) carry the curve.
    """

    def make(d, c):
        ranks = running_sums(
            d.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1)),
            ["v"], {"through": "n", "pos": "one"})
        total, m = ranks.agg(F.max("through"), F.max("pos")).first()
        if m is None or m < 2:
            return None
        if m > knots:
            cell = F.floor((F.col("pos") - 1) * F.lit((knots - 1) / (m - 1)))
            prev = F.floor((F.col("pos") - 2) * F.lit((knots - 1) / (m - 1)))
            ranks = ranks.where((F.col("pos") == 1) | (F.col("pos") == m) | (cell != prev))
        k = ranks.select("v", ((F.col("through") - 0.5 * F.col("n")) / F.lit(total)).alias("u")).toPandas().sort_values("v")
        return {"kind": "pchip", "back": "pchip", "x": k["v"].to_numpy(), "u": k["u"].to_numpy(), "clip": EPSILON}

    return _fit_curves(df, roles, make, anchor)


def fit_kde_spline(df: DataFrame, roles: Roles, anchor: bool = False) -> Curves:
    """Gaussian density on a grid, cumulated, monotone cubic through it, normal score.

    Values are counted in bins a sixty-fourth of the bandwidth wide; bins meet the grid in
    tasks that return one partial sum per grid point.
    """

    def make(d, c):
        r = d.agg(F.count(c).alias("n"), F.stddev_samp(c).alias("sd"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()
        if not r["n"] or r["sd"] is None or r["sd"] < EPSILON or r["lo"] == r["hi"]:
            return None
        h = r["sd"] * r["n"] ** (-0.2)
        margin = (r["hi"] - r["lo"]) * KDE_MARGIN
        grid = np.linspace(r["lo"] - margin, r["hi"] + margin, KDE_POINTS)
        w = h / 64.0
        bins = d.where(F.col(c).isNotNull()).groupBy(F.floor(F.col(c) / F.lit(w)).alias("b")).agg(
            F.count("*").alias("n"), F.avg(c).alias("at"))

        def partial(batches):
            acc = np.zeros(KDE_POINTS)
            for pdf in batches:
                for lo in range(0, len(pdf), 2_000):
                    part = pdf.iloc[lo:lo + 2_000]
                    z = (grid[None, :] - part["at"].to_numpy()[:, None]) / h
                    acc += part["n"].to_numpy(dtype=float) @ np.exp(-0.5 * z * z)
            yield pd.DataFrame({"i": np.arange(KDE_POINTS), "v": acc})

        pdf = bins.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
        dens = np.maximum(pdf["v"].to_numpy() / (r["n"] * h * math.sqrt(2 * math.pi)), KDE_FLOOR)
        cdf = np.cumsum(dens)
        return {"kind": "pchip", "back": "pchip", "x": grid, "u": cdf / cdf[-1], "clip": EPSILON}

    return _fit_curves(df, roles, make, anchor)


# ------------------------------------------------------------------ mixtures

@dataclass
class Modes(Fitted):
    """Value normalised within its most likely mode, plus one 0/1 column per mode."""

    mixtures: Mapping[str, dict]
    affine: Affine

    def transform(self, df):
        out = self.affine.transform(df)
        modes, values, marks = {}, {}, {}
        for c, m in self.mixtures.items():
            if c not in df.columns:
                continue
            score = ", ".join(
                f"{math.log(w)!r}D - {math.log(s)!r}D - 0.5D * pow((`{c}` - {mu!r}D) / {s!r}D, 2)" for w, mu, s in zip(m["w"], m["mean"], m["sd"]))
            modes[f"_mode_{c}"] = F.expr(f"CASE WHEN `{c}` IS NOT NULL THEN array_position(array({score}), array_max(array({score}))) END")
            pick = lambda key, c=c, m=m: F.element_at(F.array(*[F.lit(float(v)) for v in m[key]]), F.col(f"_mode_{c}").cast("int"))
            values[c] = F.coalesce((F.col(c) - pick("mean")) / (pick("sd") + F.lit(EPSILON)), F.lit(0.0))
            for k in range(len(m["w"])):
                marks[f"{c}_mode_{k}"] = F.coalesce((F.col(f"_mode_{c}") == k + 1).cast("double"), F.lit(0.0))
        return out.withColumns(modes).withColumns({**values, **marks}).drop(*modes)

    def inverse(self, df):
        out, gone = {}, []
        for c, m in self.mixtures.items():
            names = [f"{c}_mode_{k}" for k in range(len(m["w"]))]
            if c not in df.columns or names[0] not in df.columns:
                continue
            at = F.array_position(F.array(*names), F.array_max(F.array(*names))).cast("int")
            pick = lambda key: F.element_at(F.array(*[F.lit(float(v)) for v in m[key]]), at)  # noqa: E731, B023
            out[c] = F.col(c) * (pick("sd") + F.lit(EPSILON)) + pick("mean")
            gone += names
        return self.affine.inverse(df.withColumns(out).drop(*gone))


def fit_mixture(df: DataFrame, columns: Sequence[str], max_modes: int = MIXTURE_MAX) -> dict[str, dict]:
    """Gaussian mixtures with 1..max_modes parts per column by EM; lowest BIC wins.

    All columns and all sizes advance together: one aggregate of three sums per part and step.
    """
    cols = list(columns)
    stats = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in
                     (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]).first()
    data = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).persist()
    models = {}
    for i, c in enumerate(cols):
        n, m, s = stats[f"n{i}"], stats[f"m{i}"], stats[f"s{i}"]
        if not n:
            continue
        sd = math.sqrt(s * s + MIXTURE_FLOOR)
        for k in range(1, max_modes + 1):
            # Spread the starting centres over the normal quantiles of the column.
            z = [NormalDist().inv_cdf((j + 0.5) / k) for j in range(k)]
            models[(i, k)] = {"w": [1.0 / k] * k, "mean": [m + s * q for q in z], "sd": [sd / (k ** 0.5)] * k, "ll": None, "open": True}
    for _ in range(MIXTURE_STEPS):
        active = [key for key, v in models.items() if v["open"]]
        if not active:
            break
        dens, sums = [], []
        for i, k in active:
            mod = models[(i, k)]
            parts = [f"{w / (s * math.sqrt(2 * math.pi))!r}D * exp(-0.5D * pow((v{i} - {mu!r}D) / {s!r}D, 2))"
                     for w, mu, s in zip(mod["w"], mod["mean"], mod["sd"])]
            dens.append(F.expr("array(" + ", ".join(parts) + f") AS d{i}_{k}"))
            tot = f"greatest(aggregate(d{i}_{k}, 0D, (a, b) -> a + b), 1e-300D)"
            sums.append(F.expr(f"sum(CASE WHEN v{i} IS NOT NULL THEN ln({tot}) END) AS ll{i}_{k}"))
            for j in range(k):
                r = f"CASE WHEN v{i} IS NOT NULL THEN d{i}_{k}[{j}] / {tot} END"
                sums += [F.expr(f"sum({r}) AS a{i}_{k}_{j}"), F.expr(f"sum(({r}) * v{i}) AS b{i}_{k}_{j}"), F.expr(f"sum(({r}) * v{i} * v{i}) AS c{i}_{k}_{j}")]
        row = data.select("*", *dens).agg(*sums).first()
        for i, k in active:
            mod, n = models[(i, k)], stats[f"n{i}"]
            ll = row[f"ll{i}_{k}"]
            if mod["ll"] is not None and abs(ll - mod["ll"]) / n < 1e-3 or k == 1 and mod["ll"] is not None:
                mod["open"] = False
                mod["ll"] = ll
                continue
            mod["ll"] = ll
            a = np.maximum([row[f"a{i}_{k}_{j}"] for j in range(k)], 1e-10)
            b = np.array([row[f"b{i}_{k}_{j}"] for j in range(k)])
            q = np.array([row[f"c{i}_{k}_{j}"] for j in range(k)])
            mod["w"], mod["mean"] = (a / a.sum()).tolist(), (b / a).tolist()
            mod["sd"] = np.sqrt(np.maximum(q / a - (b / a) ** 2, 0.0) + MIXTURE_FLOOR).tolist()
    data.unpersist()
    best = {}
    for (i, k), mod in models.items():
        bic = -2 * mod["ll"] + (3 * k - 1) * math.log(stats[f"n{i}"])
        if cols[i] not in best or bic < best[cols[i]]["bic"]:
            best[cols[i]] = {**mod, "bic": bic, "k": k}
    return best


def fit_mode_normal(df: DataFrame, roles: Roles, max_modes: int = MIXTURE_MAX) -> Modes:
    """Mixtures for validated columns, z-scores for the rest."""
    p2 = [b for _, b in roles.numeric_pairs]
    rest = Roles(roles.key, (), tuple(c for c in roles.numeric if c not in p2))
    return Modes(fit_mixture(df, p2, max_modes), fit_zscore(df, rest))


def fit_paired_mode_normal(df: DataFrame, roles: Roles, max_modes: int = MIXTURE_MAX) -> Modes:
    """Mixture fitted on the surrogate, applied to both columns of the pair."""
    pairs = roles.numeric_pairs
    fitted = fit_mixture(df, [a for a, _ in pairs], max_modes)
    used = {c for p in pairs for c in p}
    rest = Roles(roles.key, (), tuple(c for c in roles.numeric if c not in used))
    return Modes({**fitted, **{b: fitted[a] for a, b in pairs}}, fit_zscore(df, rest) if rest.numeric else Affine({}))


# ------------------------------------------------------------------ categories

@dataclass
class Categories(Fitted):
    """Encoded columns per categorical variable; unknown or unobserved levels fall back to the mode."""

    levels: Mapping[str, list[str]]
    observed: Mapping[str, list[str]]
    fallback: Mapping[str, str]
    kind: str = "onehot"
    null_as_zero: bool = True

    @classmethod
    def fit(cls, df: DataFrame, roles: Roles, kind: str = "onehot", null_as_zero: bool = True) -> Categories:
        cols = [c for c in roles.categorical if c in df.columns]
        rows = category_profile(df, cols, roles.categorical_pairs).collect()
        levels = {c: sorted(r["level"] for r in rows if r["column"] == c) for c in cols}
        observed = {c: sorted(r["level"] for r in rows if r["column"] == c and r["n"] > 0) for c in cols}
        fallback = {r["column"]: r["level"] for r in rows if r["is_mode"]}
        return cls(levels, observed, fallback, kind, null_as_zero)

    def bits(self, column: str) -> int:
        return max(1, math.ceil(math.log2(len(self.levels[column]))))

    def encoded(self, column: str) -> list[str]:
        if self.kind == "bits":
            return [f"{column}_bit_{b}" for b in range(self.bits(column))]
        if self.kind == "ordinal":
            return [column]
        return [f"{column}_{v}" for v in self.levels[column]]

    def _code(self, c: str) -> Column:
        lookup = F.create_map(*[F.lit(x) for i, v in enumerate(self.levels[c]) for x in (v, i)])
        return F.try_element_at(lookup, F.col(c).cast("string"))

    def transform(self, df):
        new = {}
        for c in self.levels:
            text = F.col(c).cast("string")
            if self.kind == "onehot":
                for v, name in zip(self.levels[c], self.encoded(c)):
                    hit = (text == F.lit(v)).cast("double")
                    new[name] = F.coalesce(hit, F.lit(0.0)) if self.null_as_zero else hit
            elif self.kind == "bits":
                fill = F.lit(self.levels[c].index(self.fallback[c]))
                code = F.when(text.isNull(), fill).otherwise(F.coalesce(self._code(c), F.lit(0)))
                n = self.bits(c)
                for b in range(n):
                    new[f"{c}_bit_{b}"] = F.shiftright(code, n - 1 - b).bitwiseAND(F.lit(1)).cast("double") * 2.0 - 1.0
        if self.kind == "ordinal":
            return df.withColumns({c: self._code(c).cast("double") for c in self.levels})
        return df.withColumns(new).drop(*self.levels)

    def inverse(self, df):
        out = {}
        for c in self.levels:
            table = F.array(*[F.lit(v) for v in self.levels[c]])
            known = [v for v in self.levels[c] if v in set(self.observed[c])]
            if self.kind == "onehot":
                cells = F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit(float("-inf"))) for n in self.encoded(c)])
                value = F.element_at(table, F.array_position(cells, F.array_max(cells)).cast("int"))
            elif self.kind == "bits":
                n = self.bits(c)
                code = sum((F.when(F.col(f"{c}_bit_{b}") > 0, F.lit(1 << (n - 1 - b))).otherwise(F.lit(0)) for b in range(1, n)),
                           F.when(F.col(f"{c}_bit_0") > 0, F.lit(1 << (n - 1))).otherwise(F.lit(0)))
                value = F.try_element_at(table, (code + 1).cast("int"))
            else:
                idx = F.round(F.col(c)).cast("int")
                value = F.when(F.col(c).isNotNull(), F.try_element_at(table, F.greatest(idx + 1, F.lit(1))))
            good = F.when(value.isin(*known), value)
            filled = F.coalesce(good, F.lit(self.fallback[c]))
            out[c] = F.when(F.col(c).isNull(), F.lit(None)).otherwise(filled) if self.kind == "ordinal" else filled
        res = df.withColumns(out)
        return res if self.kind == "ordinal" else res.drop(*[n for c in self.levels for n in self.encoded(c)])


# ------------------------------------------------------------------ registry and pipeline

# Transforms by name, so a configuration can pick them.
NUMERIC_TRANSFORMS = {
    "zscore": fit_zscore,
    "minmax": fit_minmax,
    "quantile": fit_quantile_normal,
    "spline": fit_ecdf_spline,
    "kde_spline": fit_kde_spline,
    "gmm": lambda df, roles, anchor=False: fit_mode_normal(df, roles),
    "paired_gmm": lambda df, roles, anchor=False: fit_paired_mode_normal(df, roles),
}


@dataclass
class Pipeline(Fitted):
    """log, residual, numeric, categorical in order; the inverse in reverse, types restored."""

    stages: list[Fitted] = field(default_factory=list)
    types: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, roles: Roles, log: bool = True, residual: bool = False, numeric: str = "zscore",
            categorical: str = "onehot", anchor: bool = False) -> Pipeline:
        stages: list[Fitted] = []
        current = df
        for wanted, make in ((log, LogShift.fit), (residual, Residual.fit)):
            if wanted:
                stages.append(make(current, roles))
                current = stages[-1].transform(current)
        stages.append(NUMERIC_TRANSFORMS[numeric](current, roles, anchor=anchor))
        stages.append(Categories.fit(df, roles, categorical))
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        return cls(stages, types)

    def transform(self, df):
        for s in self.stages:
            df = s.transform(df)
        return df

    def inverse(self, df):
        for s in reversed(self.stages):
            df = s.inverse(df)
        return df.withColumns({c: F.col(c).cast(t) for c, t in self.types.items() if c in df.columns})


def schema_spans(stages: Pipeline, roles: Roles) -> list[tuple[int, int, int]]:
    """(start, end, cardinality) of each categorical variable in the encoded column list."""
    cats = next(s for s in stages.stages if isinstance(s, Categories))
    start, out = len(roles.numeric), []
    for c in cats.levels:
        width = len(cats.encoded(c))
        out.append((start, start + width, len(cats.levels[c])))
        start += width
    return out


def ordinal_table(df: DataFrame, column: str) -> DataFrame:
    """Level codes as a table (0-based), for joins on columns with very many levels."""
    return level_codes(df, column).withColumn("code", F.col("code") - 1)


def attach_ordinal(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    return join_small(df, table, [column])
