"""Narrow chains: what they write, what they delete, and their weighted-likelihood steps."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.functions.keyed import chisq_value, normal, normal_value, uniform, uniform_value
from phasewise.imputation import chained, draws, weighted_likelihood
from phasewise.imputation.chained import Target
from phasewise.session import columns_used


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(0, 1500, 1, 4).withColumn("z", normal(3, "z", "id")).withColumn("x", 0.3 + 0.8 * F.col("z") + 0.6 * normal(3, "x", "id"))
    df = df.withColumn("b", (uniform(3, "b", "id") < 1 / (1 + F.exp(-F.col("x")))).cast("int"))
    df = df.withColumns({"x": F.when(F.col("id") % 3 > 0, F.col("x")), "b": F.when(F.col("id") % 5 > 0, F.col("b"))})
    return df.withColumns({f"wide{i}": F.sha2(F.concat(F.lit(str(i)), F.col("id").cast("string")), 512) for i in range(6)})


TARGETS = {"x": Target("norm", ["z", "b"]), "b": Target("binary", ["x"])}


def files_of(cut):
    path = cut._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    return path, sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_writes_grow_with_the_missing_cells_only(spark, rows):
    full = chained.Chains(rows, TARGETS, "id", 8, 1)
    plain = chained.Chains(rows.select("id", "z", "x", "b"), TARGETS, "id", 8, 1)
    assert set(full.base.columns) == {"id", "z", "x", "b"}  # columns no term reads are not copied
    assert files_of(full.drawn)[1] == pytest.approx(files_of(plain.drawn)[1], rel=0.05)
    missing = rows.where("x IS NULL OR b IS NULL").count()
    assert full.drawn.count() == missing
    first, _ = files_of(full.drawn)
    full.step("x", 1, "sweep1")
    assert not os.path.exists(first) and os.path.exists(files_of(full.drawn)[0])


def test_completed_keeps_rows_types_and_columns(spark, rows):
    out = chained.chained_equations(rows, TARGETS, "id", m=3, maxit=2, seed=4)
    assert out.columns == [*rows.columns, "imp_id"] and out.schema["b"].dataType == rows.schema["b"].dataType
    assert out.count() == 4500 and out.where("x IS NULL OR b IS NULL OR wide5 IS NULL").count() == 0
    changed = out.alias("o").join(rows.alias("r"), "id").where("r.x IS NOT NULL AND r.x <> o.x OR r.b IS NOT NULL AND r.b <> o.b")
    assert changed.count() == 0
    again = chained.chained_equations(rows.repartition(3), TARGETS, "id", m=3, maxit=2, seed=4)
    key = lambda r: (r.imp_id, r.id)
    pairs = list(zip(sorted(out.select("imp_id", "id", "x", "b").collect(), key=key), sorted(again.select("imp_id", "id", "x", "b").collect(), key=key)))
    assert max(abs(p.x - q.x) for p, q in pairs) < 1e-8 and sum(p.b != q.b for p, q in pairs) == 0


def test_nothing_missing_and_donor_methods(spark, rows):
    whole = rows.where("x IS NOT NULL AND b IS NOT NULL").select("id", "z", "x", "b")
    assert chained.chained_equations(whole, TARGETS, "id", m=2, maxit=1).count() == 2 * whole.count()
    t = {"x": Target("pmm", {"z": F.col("z")}), "b": Target("binary", {"x": F.col("x")})}
    out = chained.chained_equations(rows, t, "id", m=2, maxit=1, seed=2)
    known = {r.x for r in rows.where("x IS NOT NULL").select("x").collect()}
    assert {r.x for r in out.select("x").collect()} <= known


def test_random_start_looks_up_missing_rows_only(spark, rows):
    out = draws.random_values(rows, "x", "id", 4, 9)
    assert out.count() == 4 * rows.where("x IS NULL").count()
    assert out.select("x").distinct().count() > 300


SPLITS, ALLOC = (-0.7, 0.7), (0.9, 0.15, 0.9)


def test_weighted_likelihoods_of_groups_equal_single_fits(spark):
    df = spark.range(0, 3000, 1, 4).withColumn("z", normal(2, "z", "id")).withColumn("x", 0.3 + 0.8 * F.col("z") + 0.6 * normal(2, "x", "id"))
    df = df.withColumn("imp_id", (F.col("id") % 3 + 1).cast("int")).withColumn("x", F.col("x") + 0.2 * F.col("imp_id"))
    df = df.where(uniform(2, "R", "id") < F.when(F.col("x") <= SPLITS[0], ALLOC[0]).when(F.col("x") >= SPLITS[1], ALLOC[2]).otherwise(ALLOC[1]))
    fits = weighted_likelihood.fit_weighted_likelihoods(df, "x", ["z"], SPLITS, ALLOC)
    assert sorted(fits) == [(1,), (2,), (3,)]
    for (i,), fit in fits.items():
        one = weighted_likelihood.fit_weighted_likelihood(df.where(F.col("imp_id") == i), "x", ["z"], SPLITS, ALLOC)
        assert np.allclose(fit.beta, one.beta, atol=1e-7) and fit.n == one.n and np.allclose(fit.cov, one.cov, rtol=1e-5)


def test_weighted_likelihood_in_a_chain(spark):
    df = spark.range(0, 4000, 1, 4).withColumn("z", normal(2, "z", "id")).withColumn("x", 0.3 + 0.8 * F.col("z") + 0.6 * normal(2, "x", "id"))
    df = df.withColumn("w", F.when(F.col("id") % 2 == 0, F.col("z") + normal(2, "w", "id")))
    p = F.when(F.col("x") <= SPLITS[0], ALLOC[0]).when(F.col("x") >= SPLITS[1], ALLOC[2]).otherwise(ALLOC[1])
    df = df.withColumn("true_x", F.col("x")).withColumn("x", F.when(uniform(2, "R", "id") < p, F.col("x")))
    options = {"splits": SPLITS, "alloc": ALLOC}
    t = {"w": Target("norm", ["z"]), "x": Target("weighted_likelihood", {"z": F.col("z"), "w": F.col("w")}, None, options)}
    out = chained.chained_equations(df, t, "id", m=3, maxit=2, seed=5)
    means = {a: out.where("x <> true_x").agg(F.avg(a)).first()[0] for a in ("x", "true_x")}
    assert abs(means["x"] - means["true_x"]) < 0.05
    t["x"] = Target("weighted_likelihood", {"z": F.col("z"), "w": F.col("w")}, None, {**options, "acceptance": "as_published"})
    plain = chained.chained_equations(df, t, "id", m=3, maxit=2, seed=5)
    # the published acceptance takes every proposal, so draws reach into the bins of rows that were nearly all selected
    outside = lambda o: o.where("x <> true_x").agg(F.avg(((F.col("x") <= SPLITS[0]) | (F.col("x") >= SPLITS[1])).cast("double"))).first()[0]
    assert outside(plain) > 2 * outside(out)
    with pytest.raises(ValueError):
        weighted_likelihood.impute_weighted_likelihood(df, "x", ["z"], SPLITS, ALLOC, "id", 1, 1, acceptance="other")


def test_plain_draws_equal_column_draws(spark):
    got = spark.range(5).select("id", uniform(7, "t", "id").alias("u"), normal(7, "t", "id").alias("n")).collect()
    assert all(r.u == uniform_value(7, "t", r.id) and abs(r.n - normal_value(7, "t", r.id)) < 1e-12 for r in got)


@pytest.mark.parametrize("df", [1, 2, 3.5, 40, 1e6])
def test_chisq_has_its_moments(df):
    v = np.array([chisq_value(df, 1, "c", i) for i in range(4000)])
    assert abs(v.mean() / df - 1) < 4 * np.sqrt(2 / df / 4000)
    assert abs(v.var() / (2 * df) - 1) < 0.25 + 2 / df
    assert (v > 0).all()


def test_columns_used(spark):
    df = spark.range(1).selectExpr("id", "1 AS a", "2 AS b", "3 AS c")
    assert columns_used(df, F.col("a") + 1, F.when(F.col("c") > 0, F.lit(1))) == ["a", "c"]


def test_weighted_likelihood_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    df = spark.range(0, 400, 1, 2).select(F.lit(1).alias("imp_id"), (normal(4, "x", "id") * 2).alias("x"), normal(4, "e", "id").alias("e"))
    df = df.select("imp_id", "x", (F.col("x") + F.col("e")).alias("y")).mapInPandas(count, "imp_id int, x double, y double")
    weighted_likelihood.fit_weighted_likelihoods(df, "y", ["x"], (-1.0, 1.0), (0.9, 0.5, 0.9), ["imp_id"])
    assert read.value == 400
