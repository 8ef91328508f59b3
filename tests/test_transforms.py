"""Curves against dense numpy, round trips, and encoders."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.functions import scalar
from phasewise.functions.keyed import normal, uniform
from phasewise.functions.tails import normal_cdf_array, normal_ppf_array, t_cdf, t_ppf
from phasewise.operators import transforms as tr
from phasewise.operators.columns import Roles

ROLES = Roles("id", (("a", "b"),), ("a", "b"))


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(0, 400, 1, 4).select(
        "id", (normal(1, "a", "id") * 2 + 1).alias("a"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 3 == 0, 0.25).otherwise(F.exp(normal(1, "b", "id"))).alias("b"))


def test_normal_functions(spark):
    x = np.linspace(-8, 8, 401)
    exact = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.allclose(normal_cdf_array(x), exact, rtol=1e-12)
    assert np.allclose(normal_ppf_array(exact[:300]), x[:300], atol=1e-8)
    got = spark.range(401).select(scalar.norm_cdf((F.col("id") - 200) / 25)).toPandas().iloc[:, 0]
    assert np.allclose(got, exact, rtol=1e-12)


def test_t_quantiles():
    assert t_ppf(0.975, 4) == pytest.approx(2.7764451051977987, abs=1e-9)
    assert t_ppf(0.975, 1) == pytest.approx(12.706204736432095, rel=1e-9)
    assert t_ppf(0.975, float("inf")) == pytest.approx(NormalDist().inv_cdf(0.975))
    assert t_cdf(t_ppf(0.9, 7.3), 7.3) == pytest.approx(0.9, abs=1e-12)


def test_pchip_is_monotone_and_exact_on_knots():
    x = np.array([0.0, 1.0, 1.5, 4.0, 9.0])
    y = np.array([0.0, 0.1, 0.6, 0.6, 1.0])
    at = np.linspace(0, 9, 500)
    v = tr.pchip(x, y, at)
    assert (np.diff(v) >= -1e-12).all()
    assert np.allclose(tr.pchip(x, y, x), y)


def test_quantile_grid_matches_numpy(frame):
    v = frame.toPandas()["b"].dropna().to_numpy()
    got = tr.quantile_grid(frame, "b", 37)
    assert np.allclose(got, np.quantile(v, np.linspace(0, 1, 37)))


def test_quantile_normal_matches_dense(frame):
    pdf = frame.toPandas()
    fit = tr.fit_quantile_normal(frame, ROLES, points=50)
    got = fit.transform(frame).toPandas().set_index("id").loc[pdf["id"]]
    v = pdf["b"].dropna().to_numpy()
    q, u = np.quantile(v, np.linspace(0, 1, 50)), np.linspace(0, 1, 50)
    w = 0.5 * (np.interp(v, q, u) - np.interp(-v, -q[::-1], -u[::-1]))
    want = [NormalDist().inv_cdf(min(max(z, 1e-7), 1 - 1e-7)) for z in w]
    ok = pdf["b"].notna().to_numpy()
    assert np.allclose(got["b"].to_numpy()[ok], want, atol=1e-8)
    assert (got["b"].to_numpy()[~ok] == 0).all()


def test_ecdf_spline_knots_and_cap(frame):
    pdf = frame.toPandas()
    full = tr.fit_ecdf_spline(frame, ROLES).transform(frame).toPandas().set_index("id").loc[pdf["id"]]
    v = pdf["a"].to_numpy()
    rank = np.searchsorted(np.sort(v), v) + 0.5
    want = normal_ppf_array(np.clip(rank / len(v), 1e-6, 1 - 1e-6))
    assert np.allclose(full["a"], want, atol=1e-8)
    capped = tr.fit_ecdf_spline(frame, ROLES, knots=60).curves["a"]
    assert len(capped["x"]) <= 61 and capped["x"][0] == v.min() and capped["x"][-1] == v.max()


def test_kde_spline_matches_dense(frame):
    pdf = frame.toPandas()
    v = pdf["a"].to_numpy()
    h = v.std(ddof=1) * len(v) ** -0.2
    m = (v.max() - v.min()) * 0.1
    grid = np.linspace(v.min() - m, v.max() + m, 1000)
    dens = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
    cdf = np.cumsum(np.maximum(dens, 1e-10))
    got = tr.fit_kde_spline(frame, ROLES).curves["a"]
    assert np.allclose(got["u"], cdf / cdf[-1], atol=1e-4)


def test_mixture_finds_two_modes(spark):
    df = spark.range(0, 4000, 1, 4).select("id", (normal(2, "m", "id") + F.when(uniform(2, "k", "id") < 0.4, -6).otherwise(5)).alias("b"))
    best = tr.fit_mixture(df, ["b"], 3)["b"]
    assert best["k"] == 2
    assert sorted(best["mean"]) == pytest.approx([-6, 5], abs=0.15)
    assert min(best["w"]) == pytest.approx(0.4, abs=0.03)


def test_bits_fall_back_to_mode(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "x"), (5, None)], "id int, c string")
    fit = tr.Categories.fit(df, Roles("id", (), (), ("c",)), "bits")
    enc = fit.transform(df)
    assert {r["id"]: (r["c_bit_0"], r["c_bit_1"]) for r in enc.collect()}[3] == (1.0, -1.0)
    bad = spark.createDataFrame([(1, 1.0, 1.0)], "id int, c_bit_0 double, c_bit_1 double")
    assert fit.inverse(bad).first()["c"] == "x"
    assert {r["id"]: r["c"] for r in fit.inverse(enc).collect()}[5] == "x"
