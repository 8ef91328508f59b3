"""Linear and generalised linear fits from grouped sufficient statistics.

One pass sums p(p+1)/2 products per group (map-side combined, so a group of any size is
fine), a p x p solve runs on those tiny rows, coefficients go back as literals or a
size-checked broadcast. Row data never leaves the executors.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasewise.functions.scalar import expit
from phasewise.functions.tails import t_ppf_array, two_sided_p
from phasewise.session import per_row_numpy, settle

INTERCEPT = "(Intercept)"
MAX_STEPS = 30
TOLERANCE = 1e-10


def unsettled(what: str, worst: float) -> None:
    """Warn that a fit ran out of steps; column ``moved`` tells which groups still moved."""
    warnings.warn(f"{what} did not converge: largest step {worst:.3g}", RuntimeWarning, stacklevel=3)


def as_terms(terms: Mapping[str, Column] | Sequence[str], intercept: bool = True) -> dict[str, Column]:
    """Model terms by name; plain column names are allowed."""
    out: dict[str, Column] = {INTERCEPT: F.lit(1.0)} if intercept else {}
    if isinstance(terms, Mapping):
        out.update({n: c.cast("double") for n, c in terms.items()})
    else:
        out.update({n: F.col(n).cast("double") for n in terms})
    return out


@dataclass
class Fit:
    """Fitted coefficients per group: arrays ``beta``, ``bread`` (inverse information), ``cov``."""

    kind: str
    family: str
    terms: dict[str, Column]
    by: list[str]
    table: DataFrame
    small: bool
    y: str | None = None
    weight: str | None = None
    extra: dict = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return list(self.terms)

    def attach(self, df: DataFrame, cols: Sequence[str] = ("beta",)) -> DataFrame:
        """Add coefficient arrays as ``_beta`` etc.: literals, broadcast or shuffle join."""
        if not self.by:
            row = self.table.select(*cols).first()
            return df.withColumns({
                f"_{c}": F.array(*[F.lit(None if v is None else float(v)).cast("double") for v in row[c]]) for c in cols
            })
        t = self.table.select(*self.by, *[F.col(c).alias(f"_{c}") for c in cols])
        return df.join(F.broadcast(t) if self.small else t, self.by, "left")

    def local(self) -> dict[str, np.ndarray]:
        """Coefficients of an ungrouped fit as numpy (p numbers)."""
        r = self.table.first()
        p = len(self.terms)
        return {"beta": np.array(r["beta"]), "bread": np.array(r["bread"]).reshape(p, p), "cov": np.array(r["cov"]).reshape(p, p)}


def eta(terms: Mapping[str, Column], beta: str = "_beta") -> Column:
    out = None
    for i, c in enumerate(terms.values()):
        part = F.col(beta)[i] * c
        out = part if out is None else out + part
    return out


def mean_of(family: str, lin: Column) -> Column:
    if family in ("binomial", "quasibinomial"):
        return expit(lin)
    return F.exp(lin) if family == "poisson" else lin


def variance_of(family: str, mu: Column) -> Column:
    if family in ("binomial", "quasibinomial"):
        return mu * (1 - mu)
    return mu if family == "poisson" else F.lit(1.0)


def model_frame(df: DataFrame, y: str, terms: Mapping[str, Column], weight: str | None, by: Sequence[str]) -> DataFrame:
    """Only the needed columns, complete rows, terms materialised as x0..xp."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    out = df.select(*by, F.col(y).cast("double").alias("_y"), w.alias("_w"), *[c.alias(f"x{i}") for i, c in enumerate(terms.values())])
    return out.dropna(subset=["_y", "_w"] + [f"x{i}" for i in range(len(terms))])


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def product_sums(p: int, factor: str) -> Column:
    """Array of the p(p+1)/2 sums of factor * xi * xj."""
    return F.expr("array(" + ", ".join(f"sum({factor} * x{i} * x{j})" for i, j in _pairs(p)) + ")")


def score_sums(p: int, factor: str) -> Column:
    return F.expr("array(" + ", ".join(f"sum({factor} * x{i})" for i in range(p)) + ")")


def gram(frame: DataFrame, p: int, by: Sequence[str], curve: str, resid: str) -> DataFrame:
    """Per group: sums of curve*x*x', resid*x and a few scalars."""
    return frame.groupBy(*by).agg(
        product_sums(p, curve).alias("A"), score_sums(p, resid).alias("g"),
        F.count("*").alias("n"), F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col("_y")).alias("wy"),
        F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("wyy"),
    )


def unpack(flat: np.ndarray, p: int) -> np.ndarray:
    """Upper-triangle sums (g, p(p+1)/2) to full matrices (g, p, p)."""
    out = np.zeros((len(flat), p, p))
    for k, (i, j) in enumerate(_pairs(p)):
        out[:, i, j] = out[:, j, i] = flat[:, k]
    return out


def safe_inverse(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse per matrix, and a flag for singular ones (pseudo-inverse used there)."""
    scale = np.sqrt(np.maximum(np.einsum("gii->gi", a), 1e-300))
    norm = a / scale[:, :, None] / scale[:, None, :]
    ok = np.array([np.linalg.cond(m) < 1e13 if np.isfinite(m).all() else False for m in norm])
    inv = np.array([np.linalg.inv(m) if good else np.linalg.pinv(np.nan_to_num(m)) for m, good in zip(norm, ok)])
    return inv / scale[:, :, None] / scale[:, None, :], ~ok


def stack_column(series: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in series])


def coef_schema(df: DataFrame, by: Sequence[str]) -> T.StructType:
    arr = T.ArrayType(T.DoubleType())
    return T.StructType([T.StructField(b, df.schema[b].dataType) for b in by] + [
        T.StructField("beta", arr), T.StructField("bread", arr), T.StructField("cov", arr),
        T.StructField("n", T.LongType()), T.StructField("df", T.DoubleType()), T.StructField("dispersion", T.DoubleType()),
        T.StructField("rss", T.DoubleType()), T.StructField("singular", T.BooleanType()), T.StructField("moved", T.DoubleType()),
    ])


def _rows(pdf: pd.DataFrame, by: Sequence[str], beta, bread, cov, df, disp, rss, singular, moved) -> pd.DataFrame:
    out = pdf[list(by)].copy()
    g = len(pdf)
    out["beta"] = list(beta)
    out["bread"] = list(bread.reshape(g, -1))
    out["cov"] = list(cov.reshape(g, -1))
    out["n"] = pdf["n"].astype("int64")
    out["df"], out["dispersion"], out["rss"] = df, disp, rss
    out["singular"], out["moved"] = singular, moved
    return out


def fit_lm(df: DataFrame, y: str, terms, weight: str | None = None, by: Sequence[str] = (), intercept: bool = True) -> Fit:
    """Weighted least squares per group."""
    by = list(by)
    terms = as_terms(terms, intercept)
    p = len(terms)
    frame = model_frame(df, y, terms, weight, by)
    sums = gram(frame, p, by, "_w", "_w * _y")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, g = unpack(stack_column(pdf["A"]).reshape(len(pdf), -1), p), stack_column(pdf["g"]).reshape(len(pdf), p)
        inv, bad = safe_inverse(a)
        beta = np.einsum("gij,gj->gi", inv, g)
        # One refinement step recovers digits lost to the normal equations.
        beta += np.einsum("gij,gj->gi", inv, g - np.einsum("gij,gj->gi", a, beta))
        rss = np.maximum(pdf["wyy"].to_numpy() - np.einsum("gi,gi->g", beta, g), 0.0)
        dof = pdf["n"].to_numpy(dtype=float) - p
        disp = np.where(dof > 0, rss / np.maximum(dof, 1), np.nan)
        return _rows(pdf, by, beta, inv, inv * disp[:, None, None], dof, disp, rss, bad, np.zeros(len(pdf)))

    table, small, _ = per_row_numpy(sums, solve, coef_schema(df, by))
    return Fit("lm", "gaussian", terms, by, table, small, y, weight)


def fit_glm(
    df: DataFrame, y: str, terms, family: str = "binomial", weight: str | None = None, by: Sequence[str] = (),
    intercept: bool = True,
) -> Fit:
    """Newton steps over grouped sums (canonical links). Gaussian is ``fit_lm``."""
    if family == "gaussian":
        return fit_lm(df, y, terms, weight, by, intercept)
    by = list(by)
    terms = as_terms(terms, intercept)
    p = len(terms)
    frame = model_frame(df, y, terms, weight, by).persist()
    xs = {n: F.col(f"x{i}") for i, n in enumerate(terms)}
    schema = coef_schema(df, by)
    first = list(terms)[0] == INTERCEPT

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        beta = np.zeros((len(pdf), p))
        if first:
            m = (pdf["wy"] / pdf["sw"]).to_numpy(dtype=float)
            beta[:, 0] = np.log(np.maximum(m, 1e-12)) if family == "poisson" else np.log(
                np.clip(m, 1e-9, 1 - 1e-9) / (1 - np.clip(m, 1e-9, 1 - 1e-9)))
        z = np.zeros((len(pdf), p, p))
        nan = np.full(len(pdf), np.nan)
        return _rows(pdf, by, beta, z, z, nan, nan, nan, np.zeros(len(pdf), bool), nan)

    table, small, _ = per_row_numpy(gram(frame, 1, by, "1D", "0D"), start, schema)
    fit = Fit("glm", family, terms, by, table, small, y, weight)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        a, g = unpack(stack_column(pdf["A"]).reshape(len(pdf), -1), p), stack_column(pdf["g"]).reshape(len(pdf), p)
        beta = stack_column(pdf["b"])
        inv, bad = safe_inverse(a)
        delta = np.einsum("gij,gj->gi", inv, g)
        # A long step means near-separation: shorten it instead of overflowing.
        big = np.abs(delta).max(axis=1)
        delta *= np.minimum(1.0, 8.0 / np.maximum(big, 1e-300))[:, None]
        new = beta + delta
        dof = pdf["n"].to_numpy(dtype=float) - p
        pearson = pdf["pearson"].to_numpy(dtype=float)
        disp = pearson / np.maximum(dof, 1) if family.startswith("quasi") else np.ones(len(pdf))
        moved = (np.abs(delta) / (1.0 + np.abs(new))).max(axis=1)
        return _rows(pdf, by, new, inv, inv * disp[:, None, None], dof, disp, pearson, bad, moved)

    for _ in range(MAX_STEPS):
        d = fit.attach(frame)
        mu = mean_of(family, eta(xs))
        d = d.withColumn("_mu", mu)
        d = d.withColumns({"_v": F.col("_w") * variance_of(family, F.col("_mu")), "_e": F.col("_w") * (F.col("_y") - F.col("_mu"))})
        sums = d.groupBy(*by).agg(
            product_sums(p, "_v").alias("A"), score_sums(p, "_e").alias("g"),
            F.count("*").alias("n"), F.first("_beta").alias("b"),
            F.sum(F.expr("_e * _e / greatest(_v, 1e-300D)")).alias("pearson"),
        )
        table, small, local = per_row_numpy(sums, step, schema)
        fit = Fit("glm", family, terms, by, table, small, y, weight)
        worst = local["moved"].max() if local is not None else table.agg(F.max("moved")).first()[0]
        if not worst > TOLERANCE:
            break
    else:
        unsettled(f"{family} fit of {y}", worst)
    frame.unpersist()
    return fit


def predict(fit: Fit, df: DataFrame, name: str = "pred", kind: str = "response") -> DataFrame:
    lin = eta(fit.terms)
    value = lin if kind == "link" else mean_of(fit.family, lin)
    return fit.attach(df).withColumn(name, value).drop("_beta")


def residuals(fit: Fit, df: DataFrame, name: str = "resid") -> DataFrame:
    """Response residuals."""
    value = F.col(fit.y).cast("double") - mean_of(fit.family, eta(fit.terms))
    return fit.attach(df).withColumn(name, value).drop("_beta")


def dfbeta(fit: Fit, df: DataFrame, which: Sequence[str] | None = None, prefix: str = "dfbeta_") -> DataFrame:
    """Change of each coefficient when the row is left out, one row expression."""
    p = len(fit.terms)
    which = list(which) if which is not None else fit.names
    d = fit.attach(df, ("beta", "bread")).withColumn("_x", F.array(*fit.terms.values()))
    mu = mean_of(fit.family, eta(fit.terms))
    d = d.withColumn("_mu", mu)
    w = F.col(fit.weight).cast("double") if fit.weight else F.lit(1.0)
    rows = [" + ".join(f"_bread[{i * p + j}] * _x[{j}]" for j in range(p)) for i in range(p)]
    d = d.withColumn("_mx", F.expr("array(" + ", ".join(rows) + ")"))
    h = F.expr(" + ".join(f"_mx[{i}] * _x[{i}]" for i in range(p)))
    # A row that determines a coefficient alone has leverage 1: its influence is undefined.
    rest = F.nullif(1 - w * variance_of(fit.family, F.col("_mu")) * h, F.lit(0.0))
    pull = w * (F.col(fit.y).cast("double") - F.col("_mu")) / rest
    d = d.withColumn("_pull", pull)
    out = {f"{prefix}{n}": F.col("_pull") * F.col("_mx")[fit.names.index(n)] for n in which}
    return d.withColumns(out).drop("_beta", "_bread", "_x", "_mu", "_mx", "_pull")


def coef_table(fit: Fit, level: float = 0.95, exponentiate: bool = False) -> DataFrame:
    """Long rows: estimate, se, limits, p. Student t for lm, normal otherwise."""
    names, p = fit.names, len(fit.names)
    long = fit.table.select(
        *fit.by, "df", F.posexplode("beta").alias("pos", "estimate"), "cov"
    ).select(*fit.by, "df", "pos", "estimate", F.sqrt(F.element_at("cov", (F.col("pos") * (p + 1) + 1).cast("int"))).alias("se"))

    def limits(pdf: pd.DataFrame) -> pd.DataFrame:
        est, se = pdf["estimate"].to_numpy(dtype=float), pdf["se"].to_numpy(dtype=float)
        use_t = fit.kind == "lm"
        dof = pdf["df"].to_numpy(dtype=float)
        q = t_ppf_array(0.5 + level / 2, dof if use_t else np.full(len(pdf), np.inf))
        out = pdf[fit.by].copy()
        out["term"] = [names[i] for i in pdf["pos"]]
        lo, hi = est - q * se, est + q * se
        out["estimate"], out["se"] = (np.exp(est) if exponentiate else est), se
        out["lower"], out["upper"] = (np.exp(lo), np.exp(hi)) if exponentiate else (lo, hi)
        with np.errstate(all="ignore"):
            out["p_value"] = two_sided_p(est / se, dof if use_t else None)
        return out

    schema = T.StructType([T.StructField(b, fit.table.schema[b].dataType) for b in fit.by] + [
        T.StructField("term", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("estimate", "se", "lower", "upper", "p_value")])
    return per_row_numpy(long, limits, schema)[0]


def fit_poisson_pruned(df: DataFrame, y: str, terms: Mapping[str, Column], groups: Mapping[str, Sequence[str]] | None = None,
                       alpha: float = 0.05, family: str = "poisson") -> Fit:
    """Fit, keep terms with p <= alpha (a factor stays if any of its levels passes), refit."""
    full = coef_table(fit_glm(df, y, terms, family)).collect()
    keep = {r["term"] for r in full if r["p_value"] is not None and r["p_value"] <= alpha}
    for members in (groups or {}).values():
        if any(m in keep for m in members):
            keep.update(members)
    return fit_glm(df, y, {n: c for n, c in terms.items() if n in keep}, family)


def sandwich(fit: Fit, scores: DataFrame, strata: str | None) -> Fit:
    """Replace ``cov`` by the stratified sandwich. ``scores`` has ``by``, ``strata`` and z0..zp.

    Per stratum the centred score products, times n/(n-1); a lone row contributes zero.
    """
    p, by = len(fit.terms), fit.by
    keys = by + ["_h"]
    z = scores.withColumn("_h", F.col(strata) if strata else F.lit(0))
    per = z.groupBy(*keys).agg(
        F.count("*").alias("_nh"),
        *[F.expr(f"sum(z{i}) AS s{i}") for i in range(p)],
        *[F.expr(f"sum(z{i} * z{j}) AS q{i}_{j}") for i, j in _pairs(p)],
    )
    meat = per.groupBy(*by).agg(F.expr("array(" + ", ".join(
        f"sum(CASE WHEN _nh > 1 THEN _nh / (_nh - 1) * (q{i}_{j} - s{i} * s{j} / _nh) ELSE 0D END)" for i, j in _pairs(p)
    ) + ")").alias("_meat"))
    joined = fit.table.join(meat, by, "inner") if by else fit.table.join(F.broadcast(meat))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        b = unpack(stack_column(pdf["_meat"]).reshape(len(pdf), -1), p)
        bread = stack_column(pdf["bread"]).reshape(len(pdf), p, p)
        out = pdf.drop(columns="_meat").copy()
        out["cov"] = list((bread @ b @ bread).reshape(len(pdf), -1))
        return out

    table, small, _ = per_row_numpy(joined, solve, fit.table.schema)
    return Fit("survey", fit.family, fit.terms, by, table, small, fit.y, fit.weight, fit.extra)


def fit_survey(df: DataFrame, y: str, terms, weight: str, strata: str | None = None, family: str = "gaussian", by: Sequence[str] = ()) -> Fit:
    """Design-weighted lm/glm with sandwich variance by strata."""
    fit = fit_glm(df, y, terms, family, weight, by)
    need = [F.col(y).isNotNull(), F.col(weight).isNotNull()] + [c.isNotNull() for c in fit.terms.values()]
    rows = df
    for c in need:
        rows = rows.where(c)
    d = residuals(fit, rows, "_e")
    z = d.select(*fit.by, *([strata] if strata else []), *[
        (F.col(weight) * F.col("_e") * c).alias(f"z{i}") for i, c in enumerate(fit.terms.values())
    ])
    return sandwich(fit, z, strata)
