"""Results that must not depend on the session or on the number of imputations."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from phasewise.imputation.chained import Target, impute_fixed
from phasewise.session import local_frame


def test_local_frame_takes_numpy_cells_with_arrow_off(spark):
    was = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        pdf = pd.DataFrame({"g": [1, 2], "beta": [np.array([0.5, 1.5]), np.array([np.nan])]})
        rows = local_frame(spark, pdf, "g bigint, beta array<double>").orderBy("g").collect()
        assert rows[0].beta == [0.5, 1.5] and np.isnan(rows[1].beta[0])
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", was)


def test_tree_draws_keep_every_imputation(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 17).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, (F.col("id") % 17 * 2).cast("double")).alias("y"))
    done = impute_fixed(df, {"y": Target("forest", ["x"], None, {"numTrees": 2, "maxDepth": 2})}, "row_id", m=7, seed=1)
    found = {r.imp_id: r["count"] for r in done.groupBy("imp_id").count().collect()}
    assert found == {i: 300 for i in range(1, 8)}
    assert done.where("y IS NULL").count() == 0
