"""Multinomial fits of many groups at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.functions.keyed import normal, uniform
from phasewise.models import multinomial
from phasewise import session

LEVELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(0, 6000, 1, 4).withColumn("g", (F.col("id") % 12).cast("int")).withColumn("x", normal(1, "x", "id")).withColumn("w", 1 + F.col("id") % 3)
    s = uniform(1, "u", "id") + 0.15 * F.col("x") + 0.01 * F.col("g")
    return df.withColumn("y", F.when(s < 0.35, "a").when(s < 0.75, "b").otherwise("c"))


def slow_fit(t, steps=60):
    x, k = np.column_stack([np.ones(len(t)), t["x"]]), t["y"].map(LEVELS.index).to_numpy()
    b, w = np.zeros((2, 2)), t["w"].to_numpy(float)
    for _ in range(steps):
        e = np.exp(np.column_stack([np.zeros(len(t)), x @ b.T]))
        pr = (e / e.sum(axis=1, keepdims=True))[:, 1:]
        grad = ((np.eye(3)[k][:, 1:] - pr) * w[:, None]).T @ x
        info = np.einsum("n,nc,cd,ni,nj->cidj", w, pr, np.eye(2), x, x) - np.einsum("n,nc,nd,ni,nj->cidj", w, pr, pr, x, x)
        b = b + np.linalg.solve(info.reshape(4, 4), grad.ravel()).reshape(2, 2)
    return b.ravel(), np.linalg.inv(info.reshape(4, 4)).ravel()


@pytest.mark.parametrize("few", [True, False])
def test_groups_equal_single_fits(spark, rows, monkeypatch, few):
    """On the driver while groups are few, in tasks beyond."""
    if not few:
        monkeypatch.setattr(multinomial, "per_row_numpy", lambda df, fn, schema: session.per_row_numpy(df, fn, schema, limit=3))
    fit = multinomial.fit_multinomial(rows, "y", LEVELS, ["x"], "w", ["g"])
    got = {r.g: r for r in fit.table.collect()}
    assert len(got) == 12 and all(r.converged and r.n == 500 for r in got.values())
    data = rows.toPandas()
    for g in (0, 5, 11):
        beta, cov = slow_fit(data[data.g == g])
        assert np.allclose(got[g].beta, beta, atol=1e-7) and np.allclose(got[g].cov, cov, rtol=1e-5, atol=1e-9)


def test_separated_group_and_no_rows(spark, rows):
    odd = rows.where("g < 2").withColumn("y", F.when(F.col("g") == 1, F.when(F.col("x") > 0, "a").otherwise("b")).otherwise(F.col("y")))
    fit = multinomial.fit_multinomial(odd, "y", LEVELS, ["x"], None, ["g"])
    got = {r.g: r for r in fit.table.collect()}
    assert got[0].converged and np.isfinite(got[1].beta).all()
    none = multinomial.fit_multinomial(rows.where("false"), "y", LEVELS, ["x"])
    assert none.table.first().beta == [0.0] * 4 and not none.table.first().converged
    assert multinomial.fit_multinomial(rows.where("false"), "y", LEVELS, ["x"], None, ["g"]).table.count() == 0
