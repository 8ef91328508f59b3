"""Cox fit and leave-one-out residuals against a dense Efron likelihood, with heavy ties."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.functions.keyed import uniform
from phasewise.models import cox


def dense(t, d, w, x):
    """Newton on the textbook Efron likelihood; returns beta, inverse information, score residuals."""
    n, p = x.shape
    beta = np.zeros(p)

    def parts(beta):
        u, info = np.zeros(p), np.zeros((p, p))
        r = np.exp(x @ beta)
        per_row = np.zeros((n, p))
        for tv in np.unique(t[d == 1]):
            risk, dead = t >= tv, (t == tv) & (d == 1)
            m = dead.sum()
            wbar = w[dead].sum() / m
            for k in range(m):
                f = k / m
                ww = w * r * (risk - f * dead)
                s0 = ww.sum()
                xb = (ww[:, None] * x).sum(0) / s0
                s2 = np.einsum("k,ki,kj->ij", ww, x, x) / s0
                u += (w[dead, None] * x[dead]).sum(0) / m - wbar * xb
                info += wbar * (s2 - np.outer(xb, xb))
                per_row += (dead[:, None] * (x - xb)) / m
                per_row -= ((r * (risk - f * dead))[:, None] * (x - xb)) * wbar / s0
        return u, info, per_row

    for _ in range(30):
        u, info, _ = parts(beta)
        beta = beta + np.linalg.solve(info, u)
    u, info, per_row = parts(beta)
    return beta, np.linalg.inv(info), per_row


@pytest.mark.parametrize("parts", [1, 5])
def test_cox_matches_dense(spark, parts, monkeypatch):
    df = spark.range(0, 240, 1, 3).select(
        "id", (F.col("id") % 2).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(2.0)).otherwise(F.floor(uniform(1, "t", "id") * 30) / 10).alias("t"),
        F.when(uniform(1, "d", "id") < 0.7, 1).otherwise(0).alias("d"), (F.lit(0.5) + uniform(1, "w", "id")).alias("w"),
        uniform(1, "x", "id").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
    )
    original = cox.range_parts

    def forced(frame, order, by=()):
        from phasewise.session import cut

        return cut(frame.repartitionByRange(parts, *[F.col(c) for c in [*by, *order]]).withColumn("_part", F.spark_partition_id()))

    monkeypatch.setattr(cox, "range_parts", forced)
    fit = cox.fit_cox(df, "t", "d", ["a", "b"], "w", ["g"])
    got = {r["g"]: r for r in fit.table.collect()}
    infl = cox.dfbeta_cox(fit, df, "t", "d", ["a", "b"], "id", "w").toPandas().set_index("id")
    pdf = df.toPandas()
    for g, sub in pdf.groupby("g"):
        beta, inv, rows = dense(*(sub[c].to_numpy(float) for c in "tdw"), sub[["a", "b"]].to_numpy(float))
        assert np.allclose(got[g]["beta"], beta, atol=1e-8)
        assert np.allclose(np.reshape(got[g]["bread"], (2, 2)), inv, atol=1e-8)
        want = rows * sub["w"].to_numpy()[:, None] @ inv
        have = infl.loc[sub["id"], ["dfbeta_a", "dfbeta_b"]].to_numpy()
        assert np.allclose(have, want, atol=1e-8)
    assert original is not forced


def test_cox_steps_read_packed_blocks(spark):
    """Steps neither sort rows nor carry them to Python one by one; the fit leaves no files behind."""
    df = spark.range(0, 4000, 1, 4).select(
        "id", F.floor(uniform(1, "t", "id") * 500).cast("double").alias("t"), F.when(uniform(1, "d", "id") < 0.7, 1).otherwise(0).alias("d"),
        uniform(1, "x", "id").alias("a"))
    data = cox.CoxData(df, "t", "d", ["a"], None, (), ["id"])
    plan = data.packed._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and data.packed.count() < 100
    sums = data.totals({(0,): np.zeros(1)})
    assert sums["n"].sum() == 4000 and sums["d"].sum() == df.agg(F.sum("d")).first()[0]
    fit = cox.fit_cox(df, "t", "d", ["a"], data=data)
    infl = cox.dfbeta_cox(fit, df, "t", "d", ["a"], "id", data=data)
    pdf = df.toPandas()
    beta, inv, rows = dense(*(pdf[c].to_numpy(float) for c in "td"), np.ones(len(pdf)), pdf[["a"]].to_numpy(float))
    assert np.allclose(fit.table.first()["beta"], beta, atol=1e-8)
    assert np.allclose(infl.toPandas().set_index("id").loc[pdf["id"], "dfbeta_a"], (rows @ inv).ravel(), atol=1e-8)
    data.drop()
    assert not pathlib.Path(data.packed._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")).exists()
