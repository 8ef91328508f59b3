"""Designs and allocation against brute force; skew and any-partitioning checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.functions.keyed import normal, uniform
from phasewise.operators import allocation, designs, resampling
from phasewise.operators.joins import knn_donors, pareto_front


def listed(ns, units, cap=None):
    """Allocation by listing every priority value."""
    pr = []
    for h, v in enumerate(ns):
        top = units + 2 if cap is None else cap[h] + 1
        pr += [(-v / np.sqrt(j * (j + 1.0)), h) for j in range(2, top + 1)] if v > 0 else []
    out = np.zeros(len(ns), dtype=int)
    for _, h in sorted(pr)[:units]:
        out[h] += 1
    return out


@pytest.mark.parametrize("units", [0, 1, 7, 53, 400])
def test_priority_counts(units):
    ns = np.array([900.0, 400.0, 33.3, 20.0, 1.0, 0.0])
    assert (allocation.priority_counts(ns, units) == listed(ns, units)).all()
    cap = np.array([5, 60, 9, 200, 1, 4])
    got = allocation.priority_counts(ns, units, cap)
    assert (got == listed(ns, units, cap)).all()
    assert (got <= cap).all()


def test_priority_counts_is_independent_of_sample_size():
    ns = np.array([3e11, 2e11, 5e9])
    got = allocation.priority_counts(ns, 10**10)
    assert got.sum() == 10**10 and (np.diff(got) < 0).all()


@pytest.fixture(scope="module")
def cohort(spark):
    df = spark.range(0, 1200, 1, 5).withColumn("x", normal(1, "x", "id"))
    df = df.withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))))
    return df.withColumn("y", 1 + 2 * F.col("x") + normal(1, "e", "id")).withColumn("rep", F.col("id") % 2)


def test_designs_have_exact_sizes(cohort):
    assert designs.srs(cohort, "id", 77, 3).agg(F.sum("R")).first()[0] == 77
    assert designs.ods_tail(cohort, "y", "id", 77).agg(F.sum("R")).first()[0] == 76
    got = {r[0]: r[1] for r in designs.ods_tail(cohort, "y", "id", 40, by=["rep"]).groupBy("rep").agg(F.sum("R")).collect()}
    assert got == {0: 40, 1: 40}
    bal = designs.balanced(cohort, "g", "id", 101, 4)
    assert bal.agg(F.sum("R")).first()[0] == 101
    w = bal.where("R = 1").groupBy("g").agg(F.sum("W").alias("w"), F.first("W")).join(cohort.groupBy("g").count(), "g").collect()
    assert all(r["w"] == pytest.approx(r["count"]) for r in w)


def test_weighted_residual_keeps_pilot(cohort):
    out = designs.weighted_residual_sampling(cohort, "y", ["x"], "x", ["y"], "id", 100, 5)
    assert out.agg(F.sum("R")).first()[0] == 100
    pilot = designs.srs(cohort, "id", 10, 5).where("R = 1").select("id")
    assert out.join(pilot, "id").agg(F.min("R")).first()[0] == 1


def test_masking_keeps_validated_rows(cohort):
    out = designs.srs(cohort, "id", 50, 3, ["x"])
    assert out.where("R = 1 and x is null").count() == 0
    assert out.where("R = 0 and x is not null").count() == 0


def test_lone_and_empty_strata(spark):
    df = spark.createDataFrame([("1.1.1", 1), ("1.1.1", 0), ("1.2.1", 1), ("1.4.1", 0), ("1.4.1", 1), ("0.1.1", 1)], "s string, R int")
    got = {r["s"]: r["fpc"] for r in allocation.merge_lone_strata(df, "s").collect()}
    assert got == {"1.1.1": 2, "1.4.1": 2, "0.1.1": 1}
    num = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 0), (5, 1)], "s int, R int")
    assert sorted(r["s"] for r in allocation.merge_empty_strata(num, "s").collect()) == [2, 2, 2, 2, 5]


def test_bootstrap_and_weighted_resample_totals(cohort):
    b = resampling.bootstrap(cohort.select("id"), "id", 3, 1)
    assert {r[0]: r[1] for r in b.groupBy("imp_id").agg(F.sum("multiplicity")).collect()} == {1: 1200, 2: 1200, 3: 1200}
    w = cohort.withColumn("w", F.when(F.col("id") == 7, 600.0).otherwise(0.5))
    r = resampling.weighted_resample(w, "id", "w", 4000, 2)
    assert r.agg(F.sum("multiplicity")).first()[0] == 4000
    hot = r.where("id = 7").first()["multiplicity"]
    assert hot / 4000 == pytest.approx(600 / (600 + 0.5 * 1199), abs=0.04)
    even = resampling.even_by_category(cohort, "g", "id", 99, 3)
    sizes = [x[0] for x in even.groupBy("g").agg(F.sum("multiplicity")).select("sum(multiplicity)").collect()]
    assert sum(sizes) == 99 and max(sizes) - min(sizes) <= 1


def test_knn_donors_with_heavy_ties(spark):
    d = spark.range(0, 300, 1, 3).select(F.col("id").alias("donor"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.round(uniform(1, "d", "id"), 2)).alias("p"))
    r = spark.range(0, 90, 1, 3).select("id", F.when(F.col("id") % 3 == 0, 0.501).otherwise(F.round(uniform(1, "r", "id"), 2)).alias("p"))
    got = knn_donors(d, r, "donor", "id", "p", 4).toPandas()
    dp, rp = d.toPandas(), r.toPandas()
    for _, row in rp.iterrows():
        want = sorted((abs(row.p - q), int(k)) for k, q in zip(dp.donor, dp.p))[:4]
        have = got[got.id == row.id].sort_values("rank")
        assert list(have.donor) == [k for _, k in want]


def test_pareto_front_brute_force(spark):
    t = spark.range(0, 400, 1, 4).select("id", F.round(uniform(1, "a", "id"), 2).alias("a"), F.round(uniform(1, "b", "id"), 2).alias("b"))
    p = t.toPandas()
    want = [r.id for r in p.itertuples() if not ((p.a <= r.a) & (p.b <= r.b) & ((p.a < r.a) | (p.b < r.b))).any()]
    assert sorted(x.id for x in pareto_front(t, "a", "b").collect()) == sorted(want)
