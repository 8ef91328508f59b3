"""The ECDF curve as a table against the same curve in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.functions.keyed import normal
from phasewise.operators import curves
from phasewise.operators.transforms import pchip_slopes


def slow_share(known, asked):
    x, n = np.unique(known, return_counts=True)
    u = (np.cumsum(n) - 0.5 * n) / n.sum()
    if len(x) == 1:
        return np.full(len(asked), u[0])
    d = pchip_slopes(x, u)
    at = np.clip(np.searchsorted(x, asked, side="right") - 1, 0, len(x) - 2)
    h = x[at + 1] - x[at]
    t = (asked - x[at]) / h
    v = (1 + 2 * t) * (1 - t) ** 2 * u[at] + t * (1 - t) ** 2 * h * d[at] + t * t * (3 - 2 * t) * u[at + 1] + t * t * (t - 1) * h * d[at + 1]
    return np.where(asked <= x[0], u[0], np.where(asked >= x[-1], u[-1], v))


@pytest.mark.parametrize("distinct", [1, 2, 3, 700])
def test_every_value_is_a_knot(spark, distinct):
    df = spark.range(0, 2000, 1, 4).withColumn("x", F.round(normal(1, "x", F.col("id") % distinct), 4)).withColumn("x", F.when(F.col("id") % 50 > 0, F.col("x")))
    ask = spark.range(0, 900, 1, 3).withColumn("v", normal(1, "v", "id") * 2).unionByName(df.where("x IS NOT NULL").limit(50).select("id", F.col("x").alias("v")))
    ask = ask.unionByName(spark.createDataFrame([(-1, None), (-2, float("inf")), (-3, -1e9)], "id bigint, v double"))
    curve = curves.fit_ecdf_curve(df, "x")
    got = curves.ecdf_score(curve, curves.ecdf_share(curve, ask, "v"), "v").toPandas()
    assert len(got) == ask.count() and got.loc[got.v.isna(), "share"].isna().all()
    rows = got.dropna(subset=["v"])
    known = df.where("x IS NOT NULL").toPandas()["x"].to_numpy()
    assert np.allclose(rows["share"], slow_share(known, np.clip(rows["v"].to_numpy(), -1e12, 1e12)), atol=1e-9)
    assert (np.diff(rows.sort_values("v")["share"]) >= -1e-12).all() and rows["score"].between(-5, 5).all()


def test_no_values(spark):
    empty = spark.createDataFrame([(1, None)], "id bigint, x double")
    curve = curves.fit_ecdf_curve(empty, "x")
    assert curve.size == 0 and curves.ecdf_share(curve, empty, "x").first().share is None
