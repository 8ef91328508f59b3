"""End-to-end flows: cohort preparation, and all methods side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasewise.imputation import chained
from phasewise.imputation.chained import Target
from phasewise.models import linear
from phasewise.operators import calibration, columns, designs, evaluation, joins
from phasewise.plans import fixtures as fx
from phasewise.plans.registry import query, rnd, srnd
from phasewise.plans.sampling import SHARE
from phasewise.session import cut
from phasewise.sources import tables as src

WINDOW = (-2.0, 0.5)


@query("cohort_preparation", f"""WITH {fx.SUBJECTS_SQL}, bad AS (SELECT DISTINCT user_id FROM ev WHERE event_type='error' AND value > 300),
    f1 AS (SELECT user_id, event_id AS event_id_v, day AS day_v, value AS value_v FROM ev WHERE event_type='purchase' AND user_id NOT IN (SELECT user_id FROM bad) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day, event_id)=1),
    f2 AS (SELECT user_id, event_id AS event_id_nv, day AS day_nv, value AS value_nv FROM ev WHERE event_type='click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day, event_id)=1),
    sp AS (SELECT user_id, min(day) AS first_day, max(day) AS last_day FROM ev GROUP BY 1),
    j AS (SELECT sp.*, f1.* EXCLUDE (user_id), f2.* EXCLUDE (user_id) FROM sp JOIN f1 USING (user_id) LEFT JOIN f2 USING (user_id)),
    hit AS (SELECT j.user_id, v.value, row_number() OVER (PARTITION BY j.user_id ORDER BY abs(v.day-j.day_v), v.day, v.event_id) AS rn FROM j JOIN ev v ON v.user_id=j.user_id AND v.event_type='view' AND v.day BETWEEN j.day_v + 1 - 2.0::DOUBLE AND j.day_v + 1 + 0.5::DOUBLE)
    SELECT j.user_id::VARCHAR AS user_id, event_id_v, event_id_nv, {srnd('day_v - first_day')} AS time, {srnd('sqrt(h.value)')} AS nearest_sqrt, coalesce(value_nv, -1.0) AS value_nv
    FROM j JOIN hit h ON h.user_id = j.user_id AND h.rn = 1""")
def cohort_preparation(spark, d):
    """Exclude, first record per subject, suffix, left joins, nearest result, complete cases, fills."""
    e, facts = fx.subjects(spark, d)
    flagged = e.where(F.col("event_type") == "error").select("user_id", F.when(F.col("value") <= 300, F.col("value")).alias("v"))
    valid = e.where(F.col("event_type") == "purchase")
    valid = joins.align_rows(valid, flagged.where("v IS NULL").select("user_id").distinct(), "user_id", "left_anti")
    first_v = joins.first_per_key(valid, "user_id", ["day", "event_id"], "day").drop("event_type")
    first_nv = joins.first_per_key(e.where(F.col("event_type") == "click"), "user_id", ["day", "event_id"], "day").drop("event_type")
    spine = e.groupBy("user_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    wide = joins.spine_join(spine, [columns.suffix_columns(first_v, "_v", ["user_id"]), columns.suffix_columns(first_nv, "_nv", ["user_id"])], "user_id")
    wide = columns.complete_cases(wide, ["day_v"]).withColumn("target", F.col("day_v") + 1)
    wide = joins.window_nearest(wide, facts.withColumn("user_id", F.col("user_id").cast("string")), "user_id", "event_id_v", "target", "day_v",
                                "day", "value", "event_id", *WINDOW, "nearest")
    wide = columns.complete_cases(wide, ["nearest"])
    out = columns.survival_times(wide, "first_day", "day_v", "last_day")
    out = columns.fill_rules(out, {"value_nv": [-1.0]})
    return out.select("user_id", "event_id_v", "event_id_nv", rnd("time").alias("time"), rnd(F.sqrt("nearest")).alias("nearest_sqrt"), "value_nv")


@query("method_comparison")
def method_comparison(spark, d):
    """One outcome model by five methods, in the long estimate format."""
    # five methods scan the rows some fifteen times: tables are joined once
    full = cut(fx.cohort(spark, d).select("row_id", "x_true", "x_star", "z_bal", "y"))
    s = designs.srs(full, "row_id", int(full.count() * SHARE), 1, ["x_true"])
    x = {"x": F.col("x_true"), "z": F.col("z_bal")}
    true = linear.coef_table(linear.fit_lm(full, "y", x))
    naive = linear.coef_table(linear.fit_lm(full, "y", {"x": F.col("x_star"), "z": F.col("z_bal")}))
    cc = linear.coef_table(linear.fit_lm(s.where("R = 1"), "y", x))
    imp = chained.impute_fixed(s, {"x_true": Target("norm", ["x_star", "z_bal", "y"])}, "row_id", 5, 2)
    mi = evaluation.pool_rubin(linear.coef_table(linear.fit_lm(imp, "y", x, by=["imp_id"])), ["term"])
    rake = linear.coef_table(calibration.raking_estimate(
        s, "gauss", "row_id", {"x_true": ("gaussian", ["x_star", "z_bal", "y"])}, {"x": F.col("x_true_impute"), "z": F.col("z_bal")}, x, "y"))
    tables = [t.withColumns({"rep": F.lit(1), "design": F.lit("SRS"), "method": F.lit(n)})
              for n, t in (("true", true), ("naive", naive), ("complete", cc), ("imputed", mi), ("raking", rake))]
    out = src.estimates_table(*tables)
    return out.select("rep", "design", "method", "term", *[rnd(c).alias(c) for c in ("estimate", "se", "lower", "upper")])
