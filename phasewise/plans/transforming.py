"""Queries for the reversible transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasewise.operators import curves
from phasewise.operators import transforms as tr
from phasewise.operators.columns import Roles
from phasewise.plans import draw_sql as ds
from phasewise.plans import fixtures as fx
from phasewise.plans.registry import query, rnd, srnd

C = fx.COHORT_SQL
R = fx.COHORT_ROLES
NUM = Roles("row_id", R.pairs, ("x_true", "x_star", "z_bal"), ("c_true", "c_star", "z_seg"))


def base(spark, d):
    return fx.cohort(spark, d).select("row_id", "x_true", "x_star", F.when(F.col("yb") == 1, F.col("z_bal")).alias("z_bal"), "c_true", "c_star", "z_seg")


B = f"{C}, b AS MATERIALIZED (SELECT row_id, x_true, x_star, CASE WHEN yb = 1 THEN z_bal END AS z_bal, c_true, c_star, z_seg FROM cohort)"


def nums(df, digits=6):
    return df.select("row_id", *[rnd(c, digits).alias(c) for c in ("x_true", "x_star", "z_bal")])


@query("log_shift", f"""WITH {B}, s AS (SELECT CASE WHEN least(min(x_true), min(x_star)) <= 0 THEN abs(least(min(x_true), min(x_star)))+1 ELSE 0 END AS p,
    CASE WHEN min(z_bal) <= 0 THEN abs(min(z_bal))+1 ELSE 0 END AS z FROM b)
    SELECT row_id, {srnd('ln(1+x_true+p)')} AS x_true, {srnd('ln(1+x_star+p)')} AS x_star, {srnd('ln(1+z_bal+z)')} AS z_bal FROM b, s""")
def log_shift(spark, d):
    f = base(spark, d)
    return nums(tr.LogShift.fit(f, NUM).transform(f))


@query("zscore", f"""WITH {B} SELECT row_id, {srnd('(x_true-avg(x_true) OVER ())/(stddev_pop(x_true) OVER ()+1e-6)')} AS x_true, {srnd('(x_star-avg(x_star) OVER ())/(stddev_pop(x_star) OVER ()+1e-6)')} AS x_star,
    {srnd('coalesce((z_bal-avg(z_bal) OVER ())/(stddev_pop(z_bal) OVER ()+1e-6), 0)')} AS z_bal FROM b""")
def zscore(spark, d):
    f = base(spark, d)
    return nums(tr.fit_zscore(f, NUM).transform(f))


@query("anchor_zscore", f"""WITH {B} SELECT row_id, {srnd('(x_true-avg(x_star) OVER ())/(stddev_pop(x_star) OVER ()+1e-6)')} AS x_true, {srnd('(x_star-avg(x_star) OVER ())/(stddev_pop(x_star) OVER ()+1e-6)')} AS x_star,
    {srnd('coalesce((z_bal-avg(z_bal) OVER ())/(stddev_pop(z_bal) OVER ()+1e-6), 0)')} AS z_bal FROM b""")
def anchor_zscore(spark, d):
    f = base(spark, d)
    return nums(tr.fit_zscore(f, NUM, anchor=True).transform(f))


def mm(c, a, b):
    return srnd(f"({c}-(min({c}) OVER () - {a}))/(max({c}) OVER () - min({c}) OVER () + {b})")


for variant, a, b in (("epsilon", "0", "1e-6"), ("margin", "1", "1")):
    def _mm(spark, d, variant=variant):
        f = base(spark, d)
        return nums(tr.fit_minmax(f, NUM, variant).transform(f))

    query(f"minmax_{variant}", f"WITH {B} SELECT row_id, {', '.join(mm(c, a, b) + ' AS ' + c for c in ('x_true', 'x_star', 'z_bal'))} FROM b")(_mm)


LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def hot(c, levels):
    return ", ".join(f"({c} = '{v}')::INTEGER::DOUBLE AS \"{c}_{v}\"" for v in levels)


@query("onehot", f"WITH {B} SELECT row_id, {hot('c_true', LEVELS)}, {hot('c_star', LEVELS)}, {hot('z_seg', SEGS)} FROM b")
def onehot(spark, d):
    f = base(spark, d)
    return tr.Categories.fit(f, NUM).transform(f).drop("x_true", "x_star", "z_bal")


@query("onehot_inverse", f"WITH {B} SELECT row_id, c_true, c_star, z_seg FROM b")
def onehot_inverse(spark, d):
    f = base(spark, d)
    fit = tr.Categories.fit(f, NUM)
    return fit.inverse(fit.transform(f)).select("row_id", "c_true", "c_star", "z_seg")


BITS = ", ".join(f"((list_position({LEVELS}, c_true)-1) >> {2 - b} & 1)*2.0::DOUBLE-1 AS c_true_bit_{b}" for b in range(3))


@query("bit_encode", f"WITH {B} SELECT row_id, {BITS}, c_true AS back FROM b")
def bit_encode(spark, d):
    f = base(spark, d).select("row_id", "c_true")
    fit = tr.Categories.fit(f, Roles("row_id", (), (), ("c_true",)), "bits")
    e = fit.transform(f)
    back = fit.inverse(e).select("row_id", F.col("c_true").alias("back"))
    return e.join(back, "row_id")


@query("ordinal_encode", f"WITH {B} SELECT row_id, (dense_rank() OVER (ORDER BY c_true)-1)::DOUBLE AS c_true, (dense_rank() OVER (ORDER BY z_seg)-1)::DOUBLE AS z_seg FROM b")
def ordinal_encode(spark, d):
    f = base(spark, d).select("row_id", "c_true", "z_seg")
    return tr.Categories.fit(f, Roles("row_id", (), (), ("c_true", "z_seg")), "ordinal").transform(f)


def round_trip(name, make, digits=6):
    """Back to the original values: the SQL is the untouched table."""

    def run(spark, d):
        f = base(spark, d).where("z_bal IS NOT NULL")
        fit = make(f)
        return nums(fit.inverse(fit.transform(f)), digits)

    query(name, f"WITH {B} SELECT row_id, {', '.join(srnd(c, digits) + ' AS ' + c for c in ('x_true', 'x_star', 'z_bal'))} FROM b WHERE z_bal IS NOT NULL")(run)


round_trip("ecdf_spline_round_trip", lambda f: tr.fit_ecdf_spline(f, NUM, knots=100_000), 5)
round_trip("mode_normal_round_trip", lambda f: tr.fit_mode_normal(f, NUM))
round_trip("paired_mode_normal_round_trip", lambda f: tr.fit_paired_mode_normal(f, NUM))
round_trip("residual_round_trip", lambda f: tr.Residual.fit(f, NUM))


@query("quantile_grid", f"WITH {B} SELECT unnest(range(1000)) AS i, {srnd('unnest(q)')} AS value FROM (SELECT quantile_cont(x_true, list_transform(range(1000), lambda i: i/999.0::DOUBLE)) AS q FROM b)")
def quantile_grid(spark, d):
    grid = tr.quantile_grid(base(spark, d), "x_true")
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(grid)], "i bigint, value double").select("i", rnd("value").alias("value"))


@query("quantile_normal")
def quantile_normal(spark, d):
    f = base(spark, d)
    return nums(tr.fit_quantile_normal(f, NUM).transform(f))


@query("kde_spline")
def kde_spline(spark, d):
    f = base(spark, d)
    return nums(tr.fit_kde_spline(f, NUM).transform(f))


@query("mode_normal")
def mode_normal(spark, d):
    f = base(spark, d)
    return tr.fit_mode_normal(f, NUM).transform(f).drop("c_true", "c_star", "z_seg")


@query("transform_stages_round_trip", f"WITH {B} SELECT row_id, {', '.join(srnd(c, 5) + ' AS ' + c for c in ('x_true', 'x_star', 'z_bal'))}, c_true, c_star, z_seg FROM b WHERE z_bal IS NOT NULL")
def transform_stages_round_trip(spark, d):
    f = base(spark, d).where("z_bal IS NOT NULL")
    p = tr.Pipeline.fit(f, NUM, log=True, residual=True, numeric="zscore", categorical="bits")
    out = p.inverse(p.transform(f))
    return out.select("row_id", *[rnd(c, 5).alias(c) for c in ("x_true", "x_star", "z_bal")], "c_true", "c_star", "z_seg")


_SCORE = ds.ppf_sql("least(greatest(sh, 1e-6), 1 - 1e-6)")


@query("ecdf_curve", f"""WITH {C}, n AS (SELECT x_true AS x, count(*) AS n FROM cohort GROUP BY 1), t AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS through, sum(n) OVER () AS total FROM n),
    g AS (SELECT x, (through - 0.5::DOUBLE*n)/total AS u FROM t), w AS (WINDOW_PART),
    k AS MATERIALIZED (SELECT *, CASE WHEN xl IS NULL THEN greatest(((2*hr+hr2)*sr - hr*sr2)/(hr+hr2), 0) WHEN xr IS NULL THEN greatest(((2*hl+hl2)*sl - hl*sl2)/(hl+hl2), 0)
      ELSE (3*hr+3*hl)/((2*hr+hl)/sl + (hr+2*hl)/sr) END AS d FROM w),
    i AS MATERIALIZED (SELECT x, u, d, xr, ur, lead(d) OVER (ORDER BY x) AS dr FROM k), e AS (SELECT min(x) AS lo, arg_min(u, x) AS ulo FROM k),
    q AS (SELECT row_id, 'known' AS part, x_true AS v FROM cohort UNION ALL SELECT row_id, 'new', x_star FROM cohort),
    j AS (SELECT q.*, i.*, (v-x)/(xr-x) AS t, xr-x AS h FROM q ASOF LEFT JOIN i ON q.v >= i.x),
    s AS (SELECT row_id, part, CASE WHEN x IS NULL THEN ulo WHEN xr IS NULL OR v = x THEN u
      ELSE (1+2*t)*(1-t)*(1-t)*u + t*(1-t)*(1-t)*h*d + t*t*(3-2*t)*ur + t*t*(t-1)*h*dr END AS sh FROM j, e)
    SELECT row_id, part, {srnd('sh')} AS share, {srnd(_SCORE, 5)} AS score FROM s""".replace("WINDOW_PART", """SELECT x, u, lag(x) OVER o AS xl, lead(x) OVER o AS xr, lead(u) OVER o AS ur,
      x - lag(x) OVER o AS hl, lead(x) OVER o - x AS hr, (u - lag(u) OVER o)/(x - lag(x) OVER o) AS sl, (lead(u) OVER o - u)/(lead(x) OVER o - x) AS sr,
      lead(x, 2) OVER o - lead(x) OVER o AS hr2, (lead(u, 2) OVER o - lead(u) OVER o)/(lead(x, 2) OVER o - lead(x) OVER o) AS sr2,
      lag(x) OVER o - lag(x, 2) OVER o AS hl2, (lag(u) OVER o - lag(u, 2) OVER o)/(lag(x) OVER o - lag(x, 2) OVER o) AS sl2 FROM g WINDOW o AS (ORDER BY x)"""))
def ecdf_curve(spark, d):
    """Share and normal score of known and of new values, every distinct value a knot."""
    f = fx.cohort(spark, d).select("row_id", "x_true", "x_star")
    curve = curves.fit_ecdf_curve(f, "x_true")
    asked = f.select("row_id", F.lit("known").alias("part"), F.col("x_true").alias("v")).unionByName(f.select("row_id", F.lit("new").alias("part"), F.col("x_star").alias("v")))
    out = curves.ecdf_share(curve, asked, "v")
    out = curves.ecdf_score(curve, out, "v")
    return out.select("row_id", "part", rnd("share").alias("share"), rnd("score", 5).alias("score"))
