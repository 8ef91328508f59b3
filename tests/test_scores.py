"""Scores of trials, repaired covariances, the category rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.functions.keyed import normal
from phasewise.operators import aggregates, columns, tuning
from phasewise.operators import evaluation as ev
from phasewise.operators.columns import Roles


def test_grouped_energy_equals_single_groups(spark):
    df = spark.range(0, 360, 1, 4).withColumn("g", F.col("id") % 3).withColumn("x", normal(1, "x", "id") * (1 + F.col("g"))).withColumn("y", normal(1, "y", "id"))
    df = df.withColumn("c", F.when(F.col("x") > 0, "a").otherwise("b"))
    other = df.withColumns({"x": F.col("x") + F.col("g"), "c": F.lit("a")}).where("g < 2 OR id % 2 = 0")
    got = {r.g: r.energy for r in ev.energy_distances(df, other, ["g"], ["x", "y"], ["c"], block_rows=30).collect()}
    for g in range(3):
        want = ev.energy_distance(df.where(F.col("g") == g), other.where(F.col("g") == g), ["x", "y"], ["c"]).first()[0]
        assert got[g] == pytest.approx(want, rel=1e-9)
    lone = {r.g: r.energy for r in ev.energy_distances(df, other.where("g = 0"), ["g"], ["x"]).collect()}
    assert lone[0] is not None and lone[1] is None and lone[2] is None


def test_trial_scores_average_over_imputations(spark):
    df = spark.range(0, 240, 1, 4).withColumn("x", normal(2, "x", "id")).withColumn("s", F.col("x") + 0.5 * normal(2, "s", "id")).withColumn("c", F.when(F.col("x") > 0, "a").otherwise("b"))
    df = df.withColumn("k", F.lit("a"))
    roles = Roles("id", (("s", "x"), ("k", "c")), ("x", "s"), ("c", "k"))
    good = lambda d: d.withColumns({"x": F.when(F.col("_miss_x"), F.col("s")).otherwise(F.col("x")), "c": F.when(F.col("_miss_c"), F.col("k")).otherwise(F.col("c"))})
    bad = lambda d: d.withColumns({"x": F.when(F.col("_miss_x"), F.lit(5.0) * F.col("imp_id")).otherwise(F.col("x")), "c": F.when(F.col("_miss_c"), F.lit("z")).otherwise(F.col("c"))})
    rows = tuning.masked_cv_scores(df, roles, {4: good, 9: bad}, 3, 2, 1).collect()
    assert sorted((r.trial, r.fold) for r in rows) == [(t, f) for t in (4, 9) for f in range(3)]
    for r in rows:
        assert r.loss == pytest.approx(r.mse + r.error + r.energy)
    by = {t: [r for r in rows if r.trial == t] for t in (4, 9)}
    assert all(r.error == pytest.approx(0.5) for r in by[9]) and all(r.error < 0.5 for r in by[4])
    assert max(r.mse for r in by[4]) < min(r.mse for r in by[9]) and max(r.energy for r in by[4]) < min(r.energy for r in by[9])


def test_matrix_repair():
    fine = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert aggregates.nearest_psd(fine) is fine
    odd = np.array([[1.0, 1.0, 1.0], [1.0, 1.0, -1.0], [1.0, -1.0, 1.0]])
    fixed = aggregates.nearest_psd(odd)
    assert (fixed == fixed.T).all() and np.linalg.eigvalsh(fixed).min() > -1e-15
    assert np.allclose(np.linalg.eigvalsh(fixed)[1:], np.linalg.eigvalsh(odd)[1:])


def test_repaired_covariance_without_common_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 1.0), (None, 4.0)], "a double, b double")
    got = {(r["row"], r["col"]): r["value"] for r in aggregates.repaired_covariance(df, ["a", "b"]).collect()}
    assert got == {("a", "a"): 0.5, ("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "b"): 4.5}


def test_robust_category(spark):
    cases = {"-1.0": "-1", "02": "2", "1e3": "1000", " 7 ": "7", "3.50": "3.50", "x ": "x", "": "", "nan": "nan", "inf": "inf", "+4.": "4", ".0": "0", "1e400": "1e400",
             "9007199254740993": "9007199254740993", "1_000": "1_000", "-0.0": "0"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string").select("v", columns.robust_category("v").alias("r"))
    assert {r.v: r.r for r in df.collect()} == {**cases, None: None}


def _all_pairs(x, y, levels):
    """Energy distance of two lists of (number, level, level) by every pair."""
    z = np.array([r[0] for r in x + y])
    z = (z - z.mean()) / z.std(ddof=1)
    dummies = np.array([[float(r[1 + i] == v) for i, vs in enumerate(levels) for v in vs] for r in x + y])
    v = np.column_stack([z, dummies])
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
    n = len(x)
    return max(2 * d[:n, n:].mean() - d[:n, :n].mean() - d[n:, n:].mean(), 0.0)


def test_energy_of_one_number_needs_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(ev, "_block_sums", None)  # blocks that meet each other are for several numbers
    rng = np.random.default_rng(3)
    draw = lambda n, shift: [(float(a), b, c) for a, b, c in zip(
        np.round(rng.standard_t(2, n) + shift, 1), rng.choice(["p", "q", "r", None], n), rng.choice(["u", "v"], n))]
    x, y = draw(300, 0.0) + [(40.0, "p", "u")], draw(250, 0.4) + [(-60.0, None, "v")]
    frames = [spark.createDataFrame(rows, "x double, c string, k string") for rows in (x, y)]
    got = ev.energy_distance(*frames, ["x"], ["c", "k"]).first()[0]
    assert got == pytest.approx(_all_pairs(x, y, [["p", "q", "r"], ["u", "v"]]), rel=1e-11)
    hole = spark.createDataFrame([(None, "p", "u")], "x double, c string, k string")
    assert ev.energy_distance(frames[0].unionByName(hole), frames[1], ["x"], ["c", "k"]).first()[0] is None


def test_energy_of_several_numbers_ships_blocks_once(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(120, 3))
    b = np.vstack([a[:60] + 1e-9, rng.normal(size=(40, 3)) + 0.3])  # nearly equal rows: differences, not products
    frames = [spark.createDataFrame([tuple(map(float, r)) for r in m], "x double, y double, z double") for m in (a, b)]
    z = np.vstack([a, b])
    z = (z - z.mean(axis=0)) / z.std(axis=0, ddof=1)
    d = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2))
    want = 2 * d[:120, 120:].mean() - d[:120, :120].mean() - d[120:, 120:].mean()
    out = ev.energy_distance(*frames, ["x", "y", "z"], block_rows=40)
    assert out.first()[0] == pytest.approx(want, rel=1e-10)
    one = F.lit(1.0)
    sums = ev._block_sums(spark.range(10).select(F.lit(0).alias("g"), F.lit(0).alias("_s"), one.alias("_n0"), one.alias("_n1"), "id"), ["g"], [F.col("id") * one], 40)
    plan = sums._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[:plan.index("Join")]  # met where they were sent, not sent again


def test_blocks_of_one_large_group_meet_without_shuffles(spark):
    n = F.lit(500.0)
    rows = spark.range(1000).select(F.lit(0).alias("g"), (F.col("id") % 2).cast("int").alias("_s"), n.alias("_n0"), n.alias("_n1"), F.col("id").cast("double").alias("v"))
    sums = ev._block_sums(rows, ["g"], [F.col("v"), F.lit(0.0)], 100)
    assert "Exchange" not in sums._jdf.queryExecution().sparkPlan().toString()  # kept blocks are read by every task
    got = {(r.s1, r.s2): r.total for r in sums.groupBy("s1", "s2").agg(F.sum("total").alias("total")).collect()}
    v = np.arange(1000.0)
    d = np.abs(v[:, None] - v[None, :])
    want = {(0, 0): d[::2, ::2].sum(), (1, 1): d[1::2, 1::2].sum(), (0, 1): d[::2, 1::2].sum()}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
