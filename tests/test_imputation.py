"""Imputers: observed values stay, known laws are recovered, fits match dense optimisation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.functions.keyed import normal, uniform
from phasewise.imputation import chained, draws, error_model, weighted_likelihood
from phasewise.imputation.chained import Target
from phasewise.models import linear, multinomial
from phasewise.operators import calibration, tuning
from phasewise.operators import evaluation as ev
from phasewise.operators.columns import Roles


@pytest.fixture(scope="module")
def cohort(spark):
    df = spark.range(0, 2000, 1, 4).withColumn("x", normal(1, "x", "id")).withColumn("star", F.col("x") + normal(1, "s", "id") * 0.5)
    df = df.withColumn("y", 1 + 2 * F.col("x") + normal(1, "e", "id"))
    df = df.withColumn("c", F.when(F.col("x") < -0.5, "lo").when(F.col("x") < 0.5, "mid").otherwise("hi"))
    df = df.withColumn("c_star", F.when(uniform(1, "c", "id") < 0.85, F.col("c")).otherwise("mid"))
    df = df.withColumn("b", (uniform(1, "b", "id") < 1 / (1 + F.exp(-F.col("x")))).cast("int"))
    return df.withColumn("R", (uniform(1, "R", "id") < 0.3).cast("int"))


def masked(df, *cols):
    return df.withColumns({c: F.when(F.col("R") == 1, F.col(c)) for c in cols})


def keeps_observed(df, out, col):
    j = out.select("id", "imp_id", F.col(col).alias("new")).join(df.where("R = 1").select("id", F.col(col).alias("old")), "id")
    return j.where("new != old").count() == 0 and out.where(F.col(col).isNull()).count() == 0


TERMS = ["star", "y"]


def test_norm_draws_pool_to_truth(spark, cohort):
    out = chained.impute_fixed(masked(cohort, "x"), {"x": Target("norm", TERMS)}, "id", 10, 3)
    assert keeps_observed(cohort, out, "x")
    est = linear.coef_table(linear.fit_lm(out, "y", ["x"], by=["imp_id"]))
    p = {r["term"]: r for r in ev.pool_rubin(est, ["term"]).collect()}["x"]
    assert abs(p["estimate"] - 2) < 4 * p["se"]
    assert 0 < p["fmi"] < 1
    assert p["upper"] - p["estimate"] > 1.9 * p["se"]


def test_draws_do_not_depend_on_partitioning(spark, cohort):
    m = masked(cohort, "x")
    a = chained.impute_fixed(m.repartition(1), {"x": Target("pmm", TERMS)}, "id", 2, 3).toPandas().sort_values(["imp_id", "id"])
    b = chained.impute_fixed(m.repartition(8), {"x": Target("pmm", TERMS)}, "id", 2, 3).toPandas().sort_values(["imp_id", "id"])
    assert np.allclose(a["x"], b["x"])
    assert set(a["x"].round(12)) <= set(cohort.where("R = 1").toPandas()["x"].round(12))


def test_binary_and_multiclass(spark, cohort):
    out = chained.impute_fixed(masked(cohort, "b"), {"b": Target("binary", {"x": F.col("x")})}, "id", 2, 3)
    assert keeps_observed(cohort, out, "b")
    assert out.agg(F.corr("b", "x")).first()[0] == pytest.approx(cohort.agg(F.corr("b", "x")).first()[0], abs=0.06)
    levels = ["lo", "mid", "hi"]
    out = chained.impute_fixed(masked(cohort, "c"), {"c": Target("multiclass", {"star": F.col("star")}, levels)}, "id", 2, 3)
    assert keeps_observed(cohort, out, "c")
    share = {r["c"]: r["count"] / 4000 for r in out.groupBy("c").count().collect()}
    true = {r["c"]: r["count"] / 2000 for r in cohort.groupBy("c").count().collect()}
    assert all(abs(share[v] - true[v]) < 0.06 for v in levels)


def test_chained_equations_runs_types_together(spark, cohort):
    t = {
        "x": Target("norm", TERMS),
        "c": Target("multiclass", {"star": F.col("star"), "x": F.col("x")}, ["lo", "mid", "hi"]),
    }
    out = chained.chained_equations(masked(cohort, "x", "c"), t, "id", 2, 2, 7)
    assert out.count() == 4000 and keeps_observed(cohort, out, "x") and keeps_observed(cohort, out, "c")


@pytest.mark.parametrize("kind,opts", [("forest", {"numTrees": 4, "maxDepth": 4}), ("boosted", {"maxIter": 4, "maxDepth": 3})])
def test_trees(spark, cohort, kind, opts):
    out = chained.impute_fixed(masked(cohort, "x"), {"x": Target(kind, {"star": 0, "y": 0, "c_star": 0}, None, {"m": 2, **opts})}, "id", 2, 3)
    assert keeps_observed(cohort, out, "x") and out.count() == 4000
    true = out.select("id", F.col("x").alias("new")).join(cohort, "id")
    assert true.agg(F.corr("new", "x")).first()[0] > 0.7


SPLITS, ALLOC = (-0.7, 0.7), (0.9, 0.15, 0.9)


@pytest.fixture(scope="module")
def selected(spark):
    df = spark.range(0, 6000, 1, 4).withColumn("z", normal(2, "z", "id")).withColumn("x", 0.3 + 0.8 * F.col("z") + 0.6 * normal(2, "x", "id"))
    p = F.when(F.col("x") <= SPLITS[0], ALLOC[0]).when(F.col("x") >= SPLITS[1], ALLOC[2]).otherwise(ALLOC[1])
    return df.withColumn("R", (uniform(2, "R", "id") < p).cast("int"))


def test_weighted_likelihood_fit_and_draws(spark, selected):
    inside = selected.where("R = 1")
    fit = weighted_likelihood.fit_weighted_likelihood(inside, "x", ["z"], SPLITS, ALLOC)
    assert fit.beta == pytest.approx([0.3, 0.8], abs=0.06) and fit.sigma == pytest.approx(0.6, abs=0.05)
    naive = linear.fit_lm(inside, "x", ["z"]).table.first()["beta"]
    assert abs(naive[1] - 0.8) > 2 * abs(fit.beta[1] - 0.8)
    # The gradient vanishes, and curvature agrees with differences of the gradient.
    pdf = inside.toPandas()
    xm, y = np.column_stack([np.ones(len(pdf)), pdf["z"]]), pdf["x"].to_numpy()
    v = weighted_likelihood.likelihood_sums(xm, y, fit.beta, fit.log_sigma, SPLITS, ALLOC)
    assert np.abs(v[1:4]).max() < 1e-4
    eps = 1e-5
    num = (weighted_likelihood.likelihood_sums(xm, y, fit.beta + [0, eps], fit.log_sigma, SPLITS, ALLOC)[1:4] - v[1:4]) / eps
    assert v[4:-2].reshape(3, 3)[1] == pytest.approx(num, rel=1e-3)
    true_mean = selected.where("R = 0").agg(F.avg("x")).first()[0]
    for by in ("sampling", "integration"):
        out = weighted_likelihood.impute_weighted_likelihood(masked(selected, "x"), "x", ["z"], SPLITS, ALLOC, "id", 3, 4, by)
        assert keeps_observed(selected, out, "x")
        assert out.where("R = 0").agg(F.avg("x")).first()[0] == pytest.approx(true_mean, abs=0.05)


def test_unselected_mean_matches_integration():
    mu, sigma = np.array([-0.4, 0.0, 1.3]), 0.6
    got = weighted_likelihood._unselected_mean(mu, sigma, SPLITS, ALLOC)
    grid = np.linspace(-8, 8, 400001)
    keep = 1 - np.where(grid <= SPLITS[0], ALLOC[0], np.where(grid <= SPLITS[1], ALLOC[1], ALLOC[2]))
    for m, g in zip(mu, got):
        w = np.exp(-0.5 * ((grid - m) / sigma) ** 2) * keep
        assert g == pytest.approx((grid * w).sum() / w.sum(), abs=1e-4)


def test_error_model(spark, cohort):
    roles = Roles("id", (("star", "x"), ("c_star", "c")), ("x", "star"), ("c", "c_star"))
    out = error_model.error_model_impute(masked(cohort, "x", "c"), roles, 2, 5, {"y": F.col("y")}, {"y": F.col("y")}, {"c": ["lo", "mid", "hi"]})
    assert keeps_observed(cohort, out, "x") and keeps_observed(cohort, out, "c")
    j = out.where("R = 0").select("id", F.col("c").alias("new"), F.col("x").alias("nx")).join(cohort, "id")
    assert j.agg(F.avg((F.col("new") == F.col("c")).cast("int"))).first()[0] > 0.7
    assert j.agg(F.corr("nx", "x")).first()[0] > 0.85


def test_redraw_stays_in_range(spark, cohort):
    s = draws.stack_copies(masked(cohort, "x").withColumn("_miss", F.col("R") == 0), 2)
    lo, hi = (cohort.where("R = 1").agg(f("x")).first()[0] for f in (F.min, F.max))
    out = error_model.redraw_out_of_range(s, {"x": (F.col("star"), F.lit(1.0))}, {"x": (lo, hi)}, "_miss", "id", 6)
    assert out.count() == 4000 and keeps_observed(cohort, out, "x")
    assert out.where((F.col("x") < lo) | (F.col("x") > hi)).count() == 0


def test_raking_totals_and_estimates(spark, cohort):
    s = calibration.two_phase(cohort)
    r = calibration.rake(s, ["star", "y"]).where("R = 1")
    t = r.agg(F.sum("w_cal"), F.sum(F.col("w_cal") * F.col("star")), F.sum(F.col("w_cal") * F.col("y"))).first()
    want = cohort.agg(F.count("*"), F.sum("star"), F.sum("y")).first()
    assert [float(v) for v in t] == pytest.approx([float(v) for v in want], rel=1e-8)
    fit = calibration.raking_estimate(masked(cohort, "x"), "gauss", "id", {"x": ("gaussian", ["star", "y"])},
                                      {"x": F.col("x_impute")}, {"x": F.col("x")}, "y")
    row = {q["term"]: q for q in linear.coef_table(fit).collect()}["x"]
    assert abs(row["estimate"] - 2) < 4 * row["se"]


def test_multinomial_gradient_is_zero(spark, cohort):
    fit = multinomial.fit_multinomial(cohort, "c_star", ["lo", "mid", "hi"], ["y"])
    d = fit.probabilities(cohort)
    for k, lev in enumerate(fit.levels):
        gap = d.agg(F.sum((F.col("c_star") == lev).cast("double") - F.col("_prob")[k]), F.sum(((F.col("c_star") == lev).cast("double") - F.col("_prob")[k]) * F.col("y"))).first()
        assert abs(gap[0]) < 1e-5 and abs(gap[1]) < 1e-5


def test_masked_cv_and_failed_trial(spark, cohort):
    roles = Roles("id", (("star", "x"),), ("x", "star"))
    good = tuning.masked_cv_score(cohort, roles, lambda s: draws.draw_norm(s, "x", TERMS, "_miss_x", "id", 4, "cv"), 4, 2, 3)
    rows = good.collect()
    assert len(rows) == 4 and all(0 < r["mse"] < 1 for r in rows)

    def broken(s):
        raise np.linalg.LinAlgError("singular")

    assert {r["mse"] for r in tuning.masked_cv_score(cohort, roles, broken, 4, 1, 3).collect()} == {1e9}


def test_pooling_identity():
    # Limits equal estimate +- t * se for a printed summary with 6% missing information.
    from phasewise.functions.tails import t_ppf

    assert t_ppf(0.975, 1250) == pytest.approx(1.9619, abs=2e-4)
    assert math.isfinite(t_ppf(0.975, 1e12))


def test_tied_predictions_use_every_donor(spark):
    df = spark.range(0, 20000, 1, 4).withColumn("_miss", F.col("id") % 2 == 1).withColumn("p", F.lit(1.0)).withColumn("imp_id", F.lit(1))
    df = df.withColumn("v", F.when(~F.col("_miss"), F.col("id")))
    got = draws.match_donors(df, "v", "p", "_miss", "id", 1, "t").where("_miss")
    row = got.agg(F.count("v").alias("n"), F.countDistinct("v").alias("donors"), F.min(F.col("v") % 2).alias("odd")).first()
    # 10,000 draws from 10,000 tied donors meet about 1 - 1/e of them
    assert row["n"] == 10000 and 6000 < row["donors"] < 6650


def test_pruning_follows_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    rows = [(s, t, f, round(float(a), 1), round(float(b), 1)) for s in (0, 1) for t in range(60) for f in range(3) for a, b in [rng.random(2)]]
    got = {(r["study"], r["trial"], r["fold"]): (r["reached"], r["pruned"])
           for r in tuning.prune_trials(spark.createDataFrame(rows, "study int, trial int, fold int, a double, b double"), "trial", "fold", "a", "b", 48, ["study"]).collect()}
    pruned = 0
    for s in (0, 1):
        loss = {(t, f): (a, b) for q, t, f, a, b in rows if q == s}
        history = {f: ([], []) for f in range(3)}
        for t in range(60):
            alive = True
            for f in range(3):
                want = (alive, False)
                if alive and f < 2:
                    for h, v in zip(history[f], loss[t, f]):
                        h.append(v)
                    high = [v > np.percentile(h, 75) for h, v in zip(history[f], loss[t, f])]
                    want = (True, bool(len(history[f][0]) >= 12 and all(high)))
                    alive = not want[1]
                    pruned += want[1]
                assert got[s, t, f] == want, (s, t, f)
    assert pruned > 3


def test_raking_without_solution_raises(spark, cohort):
    # every validated row has zero where the population mean is one: no weights reach the total
    bad = calibration.two_phase(cohort).withColumn("aux", F.when(F.col("R") == 1, 0.0).otherwise(1.0))
    with pytest.raises(ValueError, match="did not converge"):
        calibration.rake(bad, ["aux"])
