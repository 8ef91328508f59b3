"""Order statistics and ranks against brute force, with one value holding a third of the rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasewise.functions.keyed import uniform
from phasewise.operators import order


@pytest.fixture()
def skewed(spark):
    df = spark.range(0, 3000, 1, 6).withColumn("g", F.when(F.col("id") % 4 == 0, "b").otherwise("a"))
    u = uniform(1, "v", "id")
    return df.withColumn("v", F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.round(u, 3)))


@pytest.mark.parametrize("exact_rows", [50_000, 40])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_cuts_match_sort(spark, skewed, monkeypatch, exact_rows, by):
    monkeypatch.setattr(order, "EXACT_ROWS", exact_rows)
    pdf = skewed.toPandas()
    for share in (0.01, 0.3, 0.5, 0.7, 1.0):
        quota = skewed.groupBy(*by).agg(F.floor(F.count("*") * share).alias("k"))
        got = order.lowest(skewed, "v", "id", quota, "k", by).where("chosen").select("id").toPandas()["id"]
        want = []
        for _, g in (pdf.groupby(by) if by else [(None, pdf)]):
            k = int(len(g) * share)
            want += list(g.sort_values(["v", "id"]).head(k)["id"])
        assert sorted(got) == sorted(want)


def test_exact_quantiles(skewed, monkeypatch):
    monkeypatch.setattr(order, "EXACT_ROWS", 40)
    probs = [0.0, 0.19, 0.5, 0.81, 1.0]
    got = order.exact_quantiles(skewed, "v", probs, ["g"]).toPandas()
    pdf = skewed.toPandas()
    for g, sub in pdf.groupby("g"):
        for p in probs:
            val = got[(got.g == g) & (got.prob == p)]["value"].iloc[0]
            assert val == pytest.approx(sub["v"].quantile(p), abs=1e-12)


def test_uniform_rank_and_running_sums(skewed):
    df = skewed.withColumn("u", uniform(3, "r", "id"))
    got = order.uniform_rank(df, "u", "id", ["g"], per_bucket=50).toPandas()
    want = got.sort_values(["u", "id"]).groupby("g").cumcount() + 1
    assert (got["rank"] == want.reindex(got.index)).all()
    sums = order.running_sums(df.select("g", "id", "v"), ["id"], {"s": "v"}, ["g"]).toPandas()
    sums = sums.sort_values(["g", "id"])
    assert (sums["s"] - sums.groupby("g")["v"].cumsum()).abs().max() < 1e-9


def test_same_answer_for_any_partitioning(skewed):
    quota = skewed.agg(F.lit(500).alias("k"))
    a = order.lowest(skewed.repartition(1), "v", "id", quota, "k").where("chosen").select("id").toPandas()
    b = order.lowest(skewed.repartition(8), "v", "id", quota, "k").where("chosen").select("id").toPandas()
    pd.testing.assert_series_equal(a["id"].sort_values(ignore_index=True), b["id"].sort_values(ignore_index=True))
