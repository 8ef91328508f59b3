"""Donor matching where many recipients share a prediction."""

from pyspark.sql import functions as F

from phasewise.functions.keyed import normal, uniform
from phasewise.imputation import draws
from phasewise.operators import joins


def table(spark):
    df = spark.range(0, 1200, 1, 4).withColumn("imp_id", F.explode(F.array(F.lit(1), F.lit(2))))
    df = df.withColumns({"x": normal(1, "x", "id"), "_miss_y": F.col("id") % 4 > 0})
    return df.withColumn("y", F.when(~F.col("_miss_y"), F.col("x") * 2 + uniform(1, "e", "id")))


def test_trees_look_for_places_once_a_prediction(spark, monkeypatch):
    asked = []

    def spy(donors, recipients, *rest):
        asked.append((recipients.count(), recipients.select("imp_id", "_p").distinct().count()))
        return joins.nearest_donors(donors, recipients, *rest)

    monkeypatch.setattr(draws, "nearest_donors", spy)
    for kind, options in (("boosted", {"maxIter": 2, "maxDepth": 2}), ("forest", {"numTrees": 2, "maxDepth": 2})):
        out = draws.draw_tree(table(spark), "y", ["x"], "_miss_y", "id", 3, "t", kind, **options)
        assert out.count() == 2400 and out.where("y is null").count() == 0
    assert all(n == distinct < 100 for n, distinct in asked)  # 1,800 rows ask


def test_places_once_a_prediction_give_the_same_draws(spark):
    df = table(spark).withColumn("_p", F.when(F.col("id") % 50 > 0, F.round("x", 1)))
    rows, tied = (draws.match_donors(df, "y", "_p", "_miss_y", "id", 3, "t", tied=how).select("imp_id", "id", "y") for how in (False, True))
    assert rows.count() == tied.count() == 2400
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, tied.collect()), key=str)
    assert tied.where("y is null").count() == df.where("_miss_y and _p is null").count() > 0  # no prediction, no donor


def test_candidates_are_sorted_without_a_comparison_expression(spark):
    df = table(spark)
    donors, asks = (df.where(c).select("imp_id", "id", F.col("x").alias("_p")) for c in ("not _miss_y", "_miss_y"))
    near = joins.nearest_donors(donors.withColumnRenamed("id", "d"), asks, "d", "id", "_p", 5, ["imp_id"])
    assert "array_sort(flatten" not in near._jdf.queryExecution().optimizedPlan().toString()
    known = {i: sorted((r["_p"], r["d"]) for r in donors.withColumnRenamed("id", "d").where(f"imp_id = {i}").collect()) for i in (1, 2)}
    at = {(r["imp_id"], r["id"]): r["_p"] for r in asks.collect()}
    for r in near.limit(40).collect():
        want = sorted((abs(p - at[r["imp_id"], r["id"]]), d) for p, d in known[r["imp_id"]])[:5]
        assert [(e["distance"], e["donor"]) for e in r["near"]] == want
