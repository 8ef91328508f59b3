"""Standard errors after raking, against the formula in numpy and against repeated samples."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasewise.functions.keyed import uniform
from phasewise.models import linear
from phasewise.operators import calibration
from phasewise.session import local_frame


def frame(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    x, z, h = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 4, n)
    share = np.array([0.1, 0.2, 0.4, 0.05])[h]
    r = rng.random(n) < share
    pdf = pd.DataFrame({
        "row_id": np.arange(n), "x": x, "xs": x + 0.3 * rng.normal(size=n), "z": z, "h": h.astype(str), "R": r.astype(int), "y": 1 + x + 0.5 * z + rng.normal(size=n),
    })
    return pdf


SCHEMA = "row_id bigint, x double, xs double, z double, h string, R int, y double"


@pytest.mark.parametrize("strata", ["h", None])
def test_covariance_formula(spark, strata):
    pdf = frame()
    d = calibration.two_phase(local_frame(spark, pdf, SCHEMA), strata)
    d = calibration.rake(d, ["xs", "z"]).where("R = 1")
    fit = linear.fit_glm(d, "y", ["x", "z"], "gaussian", "w_cal")
    scores = linear.residuals(fit, d, "_e").selectExpr("*", "_e AS z0", "_e * x AS z1", "_e * z AS z2")
    got = calibration.two_phase_covariance(fit, scores, ["xs", "z"], strata).local()["cov"]

    t = d.toPandas()
    X = np.column_stack([np.ones(len(t)), t.x, t.z])
    C = np.column_stack([np.ones(len(t)), t["xs"], t["z"]])
    w, c = t.w.to_numpy(), t.w_cal.to_numpy()
    bread = np.linalg.inv(X.T @ (c[:, None] * X))
    u = X * (t.y.to_numpy() - X @ (bread @ X.T @ (c * t.y.to_numpy())))[:, None]
    e = u - C @ np.linalg.solve(C.T @ (w[:, None] * C), C.T @ (w[:, None] * u))
    n = (1 / t.prob).sum()
    assert abs(n - len(pdf)) < 1e-6
    s = (c[:, None] * u).sum(axis=0)
    meat = ((u * c[:, None]).T @ u - np.outer(s, s) / n) * n / (n - 1)
    for _, at in t.groupby(strata or np.zeros(len(t))).indices.items():
        v = c[at, None] * e[at]
        v = v - v.mean(axis=0)
        meat += (1 - t.prob.iloc[at[0]]) * len(at) / (len(at) - 1) * v.T @ v
    assert np.allclose(got, bread @ meat @ bread, rtol=1e-9)


def test_standard_errors_match_the_spread_of_samples(spark):
    """Means of a phase-1 cohort by raking on a good surrogate: much smaller errors than the weighted mean's, and right."""
    estimates, errors, plain = [], [], []
    for seed in range(14):
        d = calibration.rake(calibration.two_phase(local_frame(spark, frame(2000, 100 + seed), SCHEMA), "h"), ["xs", "z"]).where("R = 1").toPandas()
        w, c, x = d.w.to_numpy(), d.w_cal.to_numpy(), d.x.to_numpy()
        estimates.append((c * x).sum() / c.sum())
        plain.append((w * x).sum() / w.sum())
        one = local_frame(spark, d[["row_id", "x", "xs", "z", "h", "R", "w", "w_cal", "prob"]], "row_id bigint, x double, xs double, z double, h string, R int, w double, w_cal double, prob double")
        fit = linear.fit_glm(one, "x", [], "gaussian", "w_cal")
        scores = linear.residuals(fit, one, "z0")
        errors.append(float(calibration.two_phase_covariance(fit, scores, ["xs", "z"], "h").local()["cov"][0, 0]) ** 0.5)
    assert 0.6 < np.std(estimates, ddof=1) / np.mean(errors) < 1.6
    assert np.mean(errors) < 0.7 * np.std(plain, ddof=1)


def test_lone_rows_and_null_scores(spark):
    pdf = frame(600, 3)
    pdf.loc[pdf.h == "3", "R"] = 0
    pdf.loc[pdf.index[pdf.h == "3"][0], "R"] = 1  # a lone validated row
    d = calibration.rake(calibration.two_phase(local_frame(spark, pdf, SCHEMA), "h"), ["xs"]).where("R = 1")
    fit = linear.fit_glm(d, "y", ["x"], "gaussian", "w_cal")
    scores = linear.residuals(fit, d, "_e").selectExpr("*", "IF(row_id % 17 = 0, NULL, _e) AS z0", "_e * x AS z1")
    cov = calibration.two_phase_covariance(fit, scores, ["xs"], "h").local()["cov"]
    assert np.isfinite(cov).all() and (np.diag(cov) > 0).all()


def test_raking_estimate_reads_its_rows_once(spark):
    """Every step scans the rows; the table behind them is worked out once, and only the columns that a step reads."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(v):
        seen.add(1)
        return float(v)

    n = 400
    df = spark.range(n).select(
        "id", costly(uniform(3, "s", "id")).alias("s"), F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("R"),
        uniform(3, "e", "id").alias("e"), costly(F.lit(1.0) * F.col("id")).alias("unread"))
    df = df.withColumns({"y": F.col("s") + F.col("e"), "x": F.when(F.col("R") == 1, F.col("s") + 0.1 * F.col("e"))})
    fit = calibration.raking_estimate(df, "gauss", "id", {"x": ("gaussian", ["s"])}, {"x": F.col("x_impute")}, {"x": F.col("x")}, "y")
    assert fit.table.count() == 1
    assert seen.value <= 3 * n
