"""Two-phase calibration: inclusion weights, predictions for every row, raking, raking estimates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.models import cox, linear, multinomial
from phasewise.models.linear import Fit, product_sums, safe_inverse, score_sums, stack_column, unpack
from phasewise.session import columns_used, cut, join_small

RAKE_STEPS = 50
RAKE_TOLERANCE = 1e-12
RAKE_ACCEPTED = 1e-6


def two_phase(df: DataFrame, strata: str | None = None, r: str = "R", by: Sequence[str] = ()) -> DataFrame:
    """Adds ``prob`` (phase-2 inclusion share) and ``w`` = 1/prob, by stratum or overall."""
    keys = [*by, strata] if strata else list(by)
    counts = df.groupBy(*keys).agg((F.sum(F.col(r).cast("double")) / F.count("*")).alias("prob"))
    if keys:
        out = join_small(df, counts, keys)
    else:
        out = df.withColumn("prob", F.lit(counts.first()["prob"]))
    return out.withColumn("w", F.when(F.col("prob") > 0, 1 / F.col("prob")))


def regression_predict_all(df: DataFrame, models: Mapping[str, tuple[str, object]], r: str = "R", weight: str = "w") -> DataFrame:
    """Weighted models fitted on validated rows, predicted for every row as ``<target>_impute``.

    ``models[target] = (family, terms)``; family ``multinomial`` takes ``(levels, terms)`` as terms.
    Binary predictions are rounded, classes are the most likely one.
    """
    out = df
    inside = df.where(F.col(r) == 1)
    for target, (family, terms) in models.items():
        name = f"{target}_impute"
        if family == "multinomial":
            levels, terms = terms
            fit = multinomial.fit_multinomial(inside, target, levels, terms, weight)
            out = multinomial.predict_class(fit, out, name).drop(f"{name}_index")
        else:
            fit = linear.fit_glm(inside, target, terms, family, weight)
            out = linear.predict(fit, out, name)
            if family in ("binomial", "quasibinomial"):
                out = out.withColumn(name, (F.col(name) > 0.5).cast("int"))
    return out


def rake(df: DataFrame, aux: Sequence[str], w: str = "w", r: str = "R", by: Sequence[str] = (), name: str = "w_cal") -> DataFrame:
    """Exponential-tilt weights: phase-2 totals of ``aux`` and the intercept equal phase-1 totals.

    Newton on p+1 numbers per group; each step is one aggregate over validated rows.
    """
    by = list(by)
    p = len(aux) + 1
    scales = df.agg(*[F.max(F.abs(F.col(c))).alias(f"s{i}") for i, c in enumerate(aux)]).first()
    scaled = {"x0": F.lit(1.0)}
    for i, c in enumerate(aux):
        scaled[f"x{i + 1}"] = F.col(c) / F.lit(float(scales[f"s{i}"] or 1.0))
    terms = dict(scaled)
    totals = df.select(*by, *[c.alias(n) for n, c in scaled.items()]).groupBy(*by).agg(
        F.expr("array(" + ", ".join(f"sum(x{i})" for i in range(p)) + ") AS target"))
    inside = df.where(F.col(r) == 1).select(*by, F.col(w).cast("double").alias("_w"), *[c.alias(n) for n, c in scaled.items()]).persist()
    schema = linear.coef_schema(df, by)

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        g = len(pdf)
        return linear._rows(pdf.assign(n=0), by, np.zeros((g, p)), np.zeros((g, p, p)), np.zeros((g, p, p)),
                            np.nan, np.nan, np.nan, np.zeros(g, bool), np.full(g, np.inf))

    table, small, _ = linear.per_row_numpy(totals, start, schema)
    fit = Fit("rake", "gaussian", terms, by, table, small)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        a = unpack(stack_column(pdf["A"]).reshape(len(pdf), -1), p)
        gap = stack_column(pdf["target"]) - stack_column(pdf["g"])
        inv, bad = linear.safe_inverse(a)
        delta = np.einsum("gij,gj->gi", inv, gap)
        delta *= np.minimum(1.0, 3.0 / np.maximum(np.abs(delta).max(axis=1), 1e-300))[:, None]
        size = np.abs(gap).max(axis=1) / np.maximum(stack_column(pdf["target"])[:, 0], 1.0)
        nan = np.full(len(pdf), np.nan)
        return linear._rows(pdf, by, stack_column(pdf["b"]) + delta, inv, inv, nan, nan, nan, bad, size)

    for _ in range(RAKE_STEPS):
        d = fit.attach(inside).withColumn("_v", F.expr("_w * exp(" + " + ".join(f"_beta[{i}] * x{i}" for i in range(p)) + ")"))
        sums = d.groupBy(*by).agg(product_sums(p, "_v").alias("A"), score_sums(p, "_v").alias("g"),
                                  F.count("*").alias("n"), F.first("_beta").alias("b"))
        joined = sums.join(totals, by, "inner") if by else sums.join(F.broadcast(totals))
        table, small, local = linear.per_row_numpy(joined, step, schema)
        fit = Fit("rake", "gaussian", terms, by, table, small)
        worst = local["moved"].max() if local is not None else table.agg(F.max("moved")).first()[0]
        if worst < RAKE_TOLERANCE:
            break
    else:
        # rounding may stop short of the tolerance; totals that differ are no calibration
        if not worst < RAKE_ACCEPTED:
            raise ValueError(f"raking did not converge: totals differ by {worst:.3g} of the group size")
    inside.unpersist()
    tilt = F.exp(linear.eta(terms))
    return fit.attach(df).withColumn(name, F.when(F.col(r) == 1, F.col(w) * tilt)).drop("_beta")


def raking_estimate(
    df: DataFrame, kind: str, key: str, imputers: Mapping[str, tuple[str, object]], working: Mapping[str, Column],
    final: Mapping[str, Column], y: str | tuple[str, str], y_impute: str | tuple[str, str] | None = None,
    strata: str | None = None, r: str = "R",
) -> Fit:
    """Raking estimate for ``gauss``, ``bin`` or ``cox``.

    Predict the validated columns for everyone, fit the working model on the predictions, use its
    influence columns as calibration variables, then fit the final model on validated rows.
    For ``cox`` ``y`` (and ``y_impute``) is ``(time, event)``. Standard errors are those of
    ``two_phase_covariance``: calibration takes the explained part of the second phase away.
    """
    y_work = y_impute or y
    # every step scans the rows: the columns that some step reads are kept once
    d = cut(two_phase(df.select(_columns_read(df, [key, r, strata, y, y_work], imputers, working, final)), strata, r))
    d = regression_predict_all(d, imputers, r)
    if kind == "cox":
        data = cox.CoxData(d, y_work[0], y_work[1], working, None, (), [key])  # partitioned once, used by both steps
        fit = cox.fit_cox(d, y_work[0], y_work[1], working, data=data)
        infl = cox.dfbeta_cox(fit, d, y_work[0], y_work[1], working, key, prefix="if_", data=data)
        names = [f"if_{n}" for n in fit.names]
        # The influence columns cost two passes and a join: keep them, later steps scan them often.
        d = cut(d.join(infl, key, "inner"))
        data.drop()
    else:
        family = {"gauss": "gaussian", "bin": "binomial"}[kind]
        fit = linear.fit_glm(d, y_work, working, family)
        d = linear.dfbeta(fit, d, prefix="if_")
        names = [f"if_{n}" for n in fit.names]
    safe = {n: f"if{i}" for i, n in enumerate(names)}
    d = d.withColumnsRenamed(safe)
    aux = list(safe.values())
    # the validated rows are read by the fit and by three sums after it
    d = cut(rake(d, aux, "w", r).where(F.col(r) == 1))
    if kind == "cox":
        data = cox.CoxData(d, y[0], y[1], final, "w_cal", (), [key])
        fit = cox.fit_cox(d, y[0], y[1], final, "w_cal", data=data)
        scores = cox.score_residuals(d, y[0], y[1], final, key, fit, "w_cal", data=data).drop("_w")
        scores = scores.withColumnsRenamed({f"u{i}": f"z{i}" for i in range(len(fit.names))}).join(d, key, "inner")
    else:
        fit = linear.fit_glm(d, y, final, {"gauss": "gaussian", "bin": "quasibinomial"}[kind], "w_cal")
        scores = linear.residuals(fit, d, "_e").withColumns({f"z{i}": F.col("_e") * c for i, c in enumerate(fit.terms.values())})
    return two_phase_covariance(fit, scores, aux, strata)


def _columns_read(df: DataFrame, names: Sequence, imputers: Mapping[str, tuple[str, object]], *terms) -> list[str]:
    """Columns of ``df`` that a raking estimate reads."""
    flat = {n for name in names if name for n in ([name] if isinstance(name, str) else name)} | set(imputers)
    known = df.withColumns({f"{t}_impute": F.lit(0.0) for t in imputers})
    inner = [spec[1][1] if spec[0] == "multinomial" else spec[1] for spec in imputers.values()]
    return [c for c in df.columns if c in flat | set(columns_used(known, *[v for t in [*inner, *terms] for v in linear.as_terms(t).values()]))]


def two_phase_covariance(fit: Fit, scores: DataFrame, aux: Sequence[str], strata: str | None = None, w: str = "w", w_cal: str = "w_cal", prob: str = "prob") -> Fit:
    """``fit`` with the covariance of an estimate from a phase-2 sample whose weights were calibrated on ``aux``.

    ``scores`` holds the validated rows with their unweighted scores z0.. With N rows in phase 1, bread B, calibrated weights
    c, design weights w and e the residual of z regressed on (1, aux) with weights w, the covariance is B (M1 + M2) B:

    * M1 = N/(N-1) (sum c z z' - (sum c z)(sum c z)'/N), what a validated phase 1 would leave;
    * M2 = sum over strata of (1 - n_h/N_h) n_h/(n_h-1) (sum c^2 e e' - (sum c e)(sum c e)'/n_h), what sampling adds.

    Rows with a null score take no part; a lone row of a stratum adds nothing to M2. Two aggregates; the driver
    sees the regression of p scores on the few calibration columns.
    """
    if fit.by:
        raise ValueError("one fit at a time")
    p, q = len(fit.terms), len(aux) + 1
    zs = [f"z{i}" for i in range(p)]
    used = scores.select(
        F.col(w_cal).cast("double").alias("_c"), F.col(w).cast("double").alias("_d"), F.col(prob).cast("double").alias("_p"),
        (F.col(strata) if strata else F.lit(0)).alias("_h"), F.lit(1.0).alias("x0"),
        *[F.col(a).cast("double").alias(f"x{i + 1}") for i, a in enumerate(aux)], *zs,
    ).dropna(subset=zs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    flat = lambda parts: F.expr("array(" + ", ".join(parts) + ")")
    sums = used.agg(
        product_sums(q, "_d").alias("A"), flat([f"sum(_d * x{k} * z{i})" for i in range(p) for k in range(q)]).alias("B"),
        flat([f"sum(_c * z{i} * z{j})" for i, j in pairs]).alias("Q"), flat([f"sum(_c * z{i})" for i in range(p)]).alias("S"),
        F.sum(1 / F.col("_p")).alias("N"),
    ).first()
    inv, _ = safe_inverse(unpack(np.array([sums["A"]], float), q))
    slope = np.array(sums["B"], float).reshape(p, q) @ inv[0]
    n, first = sums["N"], np.array(sums["S"], float)
    meat = (unpack(np.array([sums["Q"]], float), p)[0] - np.outer(first, first) / n) * n / (n - 1)
    rest = used.withColumns({
        f"e{i}": F.col("_c") * (F.col(f"z{i}") - sum((F.lit(float(slope[i, k])) * F.col(f"x{k}") for k in range(q)), F.lit(0.0))) for i in range(p)
    })
    of_stratum = rest.groupBy("_h").agg(
        F.count("*").alias("n"), F.first("_p").alias("f"), *[F.sum(f"e{i}").alias(f"s{i}") for i in range(p)],
        *[F.expr(f"sum(e{i} * e{j}) AS q{i}_{j}") for i, j in pairs],
    ).where("n > 1")
    second = of_stratum.agg(flat([f"sum((1 - f) * n / (n - 1) * (q{i}_{j} - s{i} * s{j} / n))" for i, j in pairs]).alias("M")).first()["M"]
    meat = meat + unpack(np.array([[v or 0.0 for v in second]], float), p)[0]

    def replace(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.copy()
        bread = stack_column(pdf["bread"]).reshape(len(pdf), p, p)
        out["cov"] = list((bread @ meat @ bread).reshape(len(pdf), -1))
        return out

    table, small, _ = linear.per_row_numpy(fit.table, replace, fit.table.schema)
    return Fit("survey", fit.family, fit.terms, [], table, small, fit.y, fit.weight, fit.extra)
