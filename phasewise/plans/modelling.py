"""Queries for model fits, pooling and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasewise.models import cox, linear, multinomial
from phasewise.operators import evaluation as ev
from phasewise.operators import allocation, designs
from phasewise.operators.aggregates import box_summary
from phasewise.plans import fixtures as fx
from phasewise.plans.registry import query, rnd, srnd, table
from phasewise.plans.sampling import CROSSED, N, alloc_sql, crossed, draw_sql, influence2, lm2, resid2
from phasewise.session import cut

C = fx.COHORT_SQL


# ------------------------------------------------------------- SQL building blocks

def inverse3(h: str) -> str:
    """Columns i00..i22: inverse of the symmetric matrix h00..h22 of table ``h``."""
    return f"""SELECT *, (h11*h22-h12*h12)/det AS i00, (h02*h12-h01*h22)/det AS i01, (h01*h12-h02*h11)/det AS i02,
      (h00*h22-h02*h02)/det AS i11, (h01*h02-h00*h12)/det AS i12, (h00*h11-h01*h01)/det AS i22
      FROM (SELECT *, h00*(h11*h22-h12*h12)-h01*(h01*h22-h12*h02)+h02*(h01*h12-h11*h02) AS det FROM {h})"""


def newton3(y: str, x1: str, x2: str, family: str, src: str = "cohort", weight: str = "1.0::DOUBLE", steps: int = 9, tag: str = "g") -> str:
    """Common tables <tag>0..<tag>steps: Newton for y ~ 1 + x1 + x2 with a canonical link."""
    mu = {"binomial": "1/(1+exp(-eta))", "poisson": "exp(eta)", "gaussian": "eta"}[family]
    var = {"binomial": "mu*(1-mu)", "poisson": "mu", "gaussian": "1.0::DOUBLE"}[family]
    start = {"binomial": "0.0::DOUBLE", "poisson": f"ln(avg({y}))", "gaussian": "0.0::DOUBLE"}[family]
    out = [f"{tag}d AS MATERIALIZED (SELECT {y}::DOUBLE AS y, {x1}::DOUBLE AS a, {x2}::DOUBLE AS b, {weight} AS w FROM {src})",
           f"{tag}0 AS MATERIALIZED (SELECT {start} AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM {src})"]
    for k in range(1, steps + 1):
        out.append(f"""{tag}{k} AS MATERIALIZED (SELECT p0+i00*s0+i01*s1+i02*s2 AS b0, p1+i01*s0+i11*s1+i12*s2 AS b1, p2+i02*s0+i12*s1+i22*s2 AS b2,
          i00, i01, i02, i11, i12, i22, n FROM ({inverse3(f'''(SELECT any_value(b0) AS p0, any_value(b1) AS p1, any_value(b2) AS p2, count(*) AS n,
            sum(w*(y-mu)) AS s0, sum(w*(y-mu)*a) AS s1, sum(w*(y-mu)*b) AS s2, sum(w*v) AS h00, sum(w*v*a) AS h01, sum(w*v*b) AS h02,
            sum(w*v*a*a) AS h11, sum(w*v*a*b) AS h12, sum(w*v*b*b) AS h22
            FROM (SELECT *, {var} AS v FROM (SELECT *, {mu} AS mu FROM (SELECT *, b0+b1*a+b2*b AS eta FROM {tag}d, {tag}{k-1}))))''')}))""")
    return ",\n".join(out)


def cox2(time: str, event: str, x1: str, x2: str, src: str = "cohort", steps: int = 7, tag: str = "c", weight: str = "1.0::DOUBLE") -> str:
    """Newton for a two-term Cox model without tied events."""
    over = "OVER (ORDER BY t DESC)"
    out = [f"{tag}d AS MATERIALIZED (SELECT {time} AS t, {event} AS d, {x1} - (SELECT avg({x1}) FROM {src}) AS a, {x2} - (SELECT avg({x2}) FROM {src}) AS b, {weight} AS w FROM {src})",
           f"{tag}0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    for k in range(1, steps + 1):
        out.append(f"""{tag}{k} AS MATERIALIZED (SELECT p1+(h22*u1-h12*u2)/det AS b1, p2+(h11*u2-h12*u1)/det AS b2, h22/det AS v11, -h12/det AS v12, h11/det AS v22 FROM (
          SELECT *, h11*h22-h12*h12 AS det FROM (SELECT any_value(p1) AS p1, any_value(p2) AS p2, sum(w*(a-m1)) AS u1, sum(w*(b-m2)) AS u2, sum(w*(q11/s0-m1*m1)) AS h11, sum(w*(q12/s0-m1*m2)) AS h12, sum(w*(q22/s0-m2*m2)) AS h22
          FROM (SELECT *, s1/s0 AS m1, s2/s0 AS m2 FROM (SELECT d, a, b, w, b1 AS p1, b2 AS p2, sum(r) {over} AS s0, sum(r*a) {over} AS s1, sum(r*b) {over} AS s2, sum(r*a*a) {over} AS q11,
            sum(r*a*b) {over} AS q12, sum(r*b*b) {over} AS q22 FROM (SELECT *, w*exp(b1*a+b2*b) AS r FROM {tag}d, {tag}{k-1}))) WHERE d = 1)))""")
    return ",\n".join(out)


def eliminate(src: str, n: int) -> str:
    """Solution x0..x(n-1) of the symmetric system h<i>_<j>, g<i> in the one-row table ``src``; other columns stay."""
    sql = f"SELECT * FROM {src}"
    for k in range(n):
        parts = [f"h{i}_{j} - h{k}_{i}/h{k}_{k}*h{k}_{j} AS h{i}_{j}" for i in range(k + 1, n) for j in range(i, n)]
        parts += [f"g{i} - h{k}_{i}/h{k}_{k}*g{k} AS g{i}" for i in range(k + 1, n)]
        if parts:
            sql = f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})"
    for k in range(n - 1, -1, -1):
        rest = "".join(f" - h{k}_{j}*x{j}" for j in range(k + 1, n))
        sql = f"SELECT *, (g{k}{rest})/h{k}_{k} AS x{k} FROM ({sql})"
    return sql


def multinomial_sql(y: str, levels: list[str], xs: list[str], src: str = "cohort", steps: int = 7, tag: str = "q") -> str:
    """Newton for a multinomial logit; the first level is the reference."""
    p, m = len(xs), len(levels) - 1
    n = m * p
    cols = ", ".join(f"{x}::DOUBLE AS v{i}" for i, x in enumerate(xs))
    out = [f"{tag}d AS MATERIALIZED (SELECT {y} AS y, {cols} FROM {src})",
           f"{tag}0 AS MATERIALIZED (SELECT {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(n))})"]
    for k in range(1, steps + 1):
        e = ", ".join("exp(" + " + ".join(f"b{c * p + i}*v{i}" for i in range(p)) + f") AS e{c}" for c in range(m))
        pr = ", ".join(f"e{c}/tot AS p{c}" for c in range(m))
        sums = [f"any_value(b{i}) AS b{i}" for i in range(n)]
        sums += [f"sum(((y = '{levels[c + 1]}')::INTEGER - p{c})*v{i}) AS g{c * p + i}" for c in range(m) for i in range(p)]
        for a in range(n):
            for b in range(a, n):
                ca, ia, cb, ib = a // p, a % p, b // p, b % p
                v = f"p{ca}*(1-p{ca})" if ca == cb else f"-p{ca}*p{cb}"
                sums.append(f"sum({v}*v{ia}*v{ib}) AS h{a}_{b}")
        tot = "1.0::DOUBLE + " + " + ".join(f"e{c}" for c in range(m))
        inner = f"(SELECT {', '.join(sums)} FROM (SELECT *, {pr} FROM (SELECT *, {tot} AS tot FROM (SELECT *, {e} FROM {tag}d, {tag}{k - 1}))))"
        out.append(f"{tag}{k} AS MATERIALIZED (SELECT {', '.join(f'b{i}+x{i} AS b{i}' for i in range(n))} FROM ({eliminate(inner, n)}))")
    return ",\n".join(out)


def long_terms(spec: list[tuple[str, str, str]], src: str, digits: int = 6) -> str:
    """(term, estimate, se) rows from expressions over a one-row table."""
    return " UNION ALL ".join(f"SELECT '{t}' AS term, {srnd(e, digits)} AS estimate, {srnd(s, digits)} AS se FROM {src}" for t, e, s in spec)


def short(df):
    return df.select("term", rnd("estimate").alias("estimate"), rnd("se").alias("se"))


# ------------------------------------------------------------- fits

@query("fit_lm", f"""WITH {C}, {lm2('y', 'x_star', 'z_bal')}, v AS (SELECT *, (syy - ba*say - bb*sby)/(n-3) AS s2 FROM m)
    {long_terms([('(Intercept)', 'my-ba*ma-bb*mb', 'sqrt(s2*(1/n + (ma*ma*sbb - 2*ma*mb*sab + mb*mb*saa)/det))'), ('x_star', 'ba', 'sqrt(s2*sbb/det)'), ('z_bal', 'bb', 'sqrt(s2*saa/det)')], 'v')}""")
def fit_lm(spark, d):
    return short(linear.coef_table(linear.fit_lm(fx.cohort(spark, d), "y", ["x_star", "z_bal"])))


@query("fit_lm_grouped", f"""WITH {C} SELECT row_id % 20 AS rep, z_seg, {srnd('regr_slope(y, x_star)')} AS slope, {srnd('regr_intercept(y, x_star)')} AS intercept, count(*) AS n FROM cohort GROUP BY ALL""")
def fit_lm_grouped(spark, d):
    f = fx.cohort(spark, d).withColumn("rep", F.col("row_id") % 20)
    t = linear.fit_lm(f, "y", ["x_star"], by=["rep", "z_seg"]).table
    return t.select("rep", "z_seg", rnd(F.col("beta")[1]).alias("slope"), rnd(F.col("beta")[0]).alias("intercept"), "n")


GLM_ROWS = [("(Intercept)", "b0", "sqrt(i00)"), ("x_true", "b1", "sqrt(i11)"), ("z_bal", "b2", "sqrt(i22)")]


@query("fit_logistic", f"WITH {C}, {newton3('yb', 'x_true', 'z_bal', 'binomial', steps=12)} {long_terms(GLM_ROWS, 'g12')}")
def fit_logistic(spark, d):
    return short(linear.coef_table(linear.fit_glm(fx.cohort(spark, d), "yb", ["x_true", "z_bal"], "binomial")))


POIS_ROWS = [("(Intercept)", "b0", "sqrt(i00)"), ("l_discount", "b1", "sqrt(i11)"), ("l_tax", "b2", "sqrt(i22)")]


@query("fit_poisson", f"WITH {newton3('l_quantity', 'l_discount', 'l_tax', 'poisson', 'lineitem', steps=10)} {long_terms(POIS_ROWS, 'g10')}")
def fit_poisson(spark, d):
    return short(linear.coef_table(linear.fit_glm(table(spark, d, "lineitem"), "l_quantity", ["l_discount", "l_tax"], "poisson")))


@query("fit_poisson_pruned", f"""WITH lp AS (SELECT *, l_linenumber::DOUBLE AS ln, CASE WHEN l_returnflag = 'A' THEN l_quantity + l_discount*20 ELSE l_quantity END AS y FROM lineitem),
    {newton3('y', 'l_discount', '(CASE WHEN l_returnflag = ' + chr(39) + 'A' + chr(39) + ' THEN 1.0 ELSE 0.0 END)', 'poisson', 'lp', steps=10)}
    {long_terms([('(Intercept)', 'b0', 'sqrt(i00)'), ('l_discount', 'b1', 'sqrt(i11)'), ('is_a', 'b2', 'sqrt(i22)')], 'g10')}""")
def fit_poisson_pruned(spark, d):
    li = table(spark, d, "lineitem")
    y = F.when(F.col("l_returnflag") == "A", F.col("l_quantity") + F.col("l_discount") * 20).otherwise(F.col("l_quantity"))
    noise = F.col("l_orderkey") % 2 * 2.0 - 1.0
    f = li.withColumns({"y": y, "is_a": (F.col("l_returnflag") == "A").cast("double"), "coin": noise * (F.col("l_partkey") % 2 * 2.0 - 1.0)})
    # ``coin`` carries no signal: the first fit drops it, ``is_a`` stays through its group.
    terms = {"l_discount": F.col("l_discount"), "is_a": F.col("is_a"), "coin": F.col("coin")}
    fit = linear.fit_poisson_pruned(f, "y", terms, {"flag": ["is_a", "l_discount"]}, alpha=1e-4)
    return short(linear.coef_table(fit))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("fit_multinomial", f"""WITH {C}, {multinomial_sql('c_star', PRIORITIES, ['1', '(x_star - 12)', 'z_bal'])}
    {' UNION ALL '.join(f"SELECT {i} AS pos, {srnd(f'b{i}', 5)} AS estimate FROM q7" for i in range(12))}""")
def fit_multinomial(spark, d):
    f = fx.cohort(spark, d)
    fit = multinomial.fit_multinomial(f, "c_star", PRIORITIES, {"x_star": F.col("x_star") - 12, "z_bal": F.col("z_bal")})
    return fit.table.select(F.posexplode("beta").alias("pos", "estimate")).select("pos", rnd("estimate", 5).alias("estimate"))


@query("fit_binary_as_multinomial", f"WITH {C}, {newton3('yb', 'x_true', 'z_bal', 'binomial', steps=12)} SELECT 0 AS pos, {srnd('b0')} AS estimate FROM g12 UNION ALL SELECT 1, {srnd('b1')} FROM g12 UNION ALL SELECT 2, {srnd('b2')} FROM g12")
def fit_binary_as_multinomial(spark, d):
    fit = multinomial.fit_multinomial(fx.cohort(spark, d), "yb", [0, 1], ["x_true", "z_bal"])
    return fit.table.select(F.posexplode("beta").alias("pos", "estimate")).select("pos", rnd("estimate").alias("estimate"))


COX_ROWS = [("x_true", "b1", "sqrt(v11)"), ("z_bal", "b2", "sqrt(v22)")]


@query("fit_cox", f"WITH {C}, {cox2('time', 'event', 'x_true', 'z_bal')} {long_terms(COX_ROWS, 'c7')}")
def fit_cox(spark, d):
    return short(linear.coef_table(cox.fit_cox(fx.cohort(spark, d), "time", "event", ["x_true", "z_bal"])))


@query("risk_set_sums", f"""WITH {C}, t AS (SELECT time, count(*) AS n, sum(x_star) AS sx, sum(x_star*x_star) AS sxx FROM cohort GROUP BY 1)
    SELECT {srnd('time', 9)} AS time, (sum(n) OVER (ORDER BY time DESC))::BIGINT AS s0, {srnd('sum(sx) OVER (ORDER BY time DESC)', 4)} AS s1, {srnd('sum(sxx) OVER (ORDER BY time DESC)', 4)} AS s2 FROM t""")
def risk_set_sums(spark, d):
    from phasewise.operators.order import running_sums

    t = fx.cohort(spark, d).groupBy((-F.col("time")).alias("_neg")).agg(
        F.count("*").alias("n"), F.sum("x_star").alias("sx"), F.sum(F.col("x_star") * F.col("x_star")).alias("sxx"))
    out = running_sums(t, ["_neg"], {"s0": "n", "s1": "sx", "s2": "sxx"})
    return out.select(rnd(-F.col("_neg"), 9).alias("time"), "s0", rnd("s1", 4).alias("s1"), rnd("s2", 4).alias("s2"))


@query("predict_lm", f"WITH {C}, {lm2('y', 'x_star', 'z_bal')} SELECT row_id, {srnd('my + ba*(x_star-ma) + bb*(z_bal-mb)')} AS pred FROM cohort, m")
def predict_lm(spark, d):
    f = fx.cohort(spark, d)
    return linear.predict(linear.fit_lm(f, "y", ["x_star", "z_bal"]), f).select("row_id", rnd("pred").alias("pred"))


@query("residuals_lm", f"WITH {C}, {lm2('y', 'x_star', 'z_bal')} SELECT row_id, {srnd(resid2('y', 'x_star', 'z_bal'))} AS resid FROM cohort, m")
def residuals_lm(spark, d):
    f = fx.cohort(spark, d)
    return linear.residuals(linear.fit_lm(f, "y", ["x_star", "z_bal"]), f).select("row_id", rnd("resid").alias("resid"))


@query("dfbeta_lm", f"WITH {C}, {lm2('y', 'x_star', 'z_bal')} SELECT row_id, {srnd(influence2('y', 'x_star', 'z_bal'), 10)} AS dfbeta FROM cohort, m")
def dfbeta_lm(spark, d):
    f = fx.cohort(spark, d)
    out = linear.dfbeta(linear.fit_lm(f, "y", ["x_star", "z_bal"]), f, ["x_star"])
    return out.select("row_id", rnd("dfbeta_x_star", 10).alias("dfbeta"))


GLM_INF = "(i01 + i11*x_true + i12*z_bal)*(yb-mu)/(1 - mu*(1-mu)*(i00 + 2*i01*x_true + 2*i02*z_bal + i11*x_true*x_true + 2*i12*x_true*z_bal + i22*z_bal*z_bal))"


@query("dfbeta_glm", f"""WITH {C}, {newton3('yb', 'x_true', 'z_bal', 'binomial', steps=12)}
    SELECT row_id, {srnd(GLM_INF, 9)} AS dfbeta FROM (SELECT *, 1/(1+exp(-(b0+b1*x_true+b2*z_bal))) AS mu FROM cohort, g12)""")
def dfbeta_glm(spark, d):
    f = fx.cohort(spark, d)
    out = linear.dfbeta(linear.fit_glm(f, "yb", ["x_true", "z_bal"], "binomial"), f, ["x_true"])
    return out.select("row_id", rnd("dfbeta_x_true", 9).alias("dfbeta"))


DFB_COX = f"""{C}, {cox2('time', 'event', 'x_star', 'z_bal')},
    r AS (SELECT row_id, time AS t, event AS d, x_star - (SELECT avg(x_star) FROM cohort) AS a, z_bal - (SELECT avg(z_bal) FROM cohort) AS b FROM cohort),
    e AS (SELECT *, exp(b1*a+b2*b) AS r FROM r, c7),
    rs AS (SELECT *, sum(r) OVER w AS s0, sum(r*a) OVER w AS s1, sum(r*b) OVER w AS s2 FROM e WINDOW w AS (ORDER BY t DESC)),
    z AS (SELECT *, sum(d/s0) OVER v AS h, sum(d*s1/s0/s0) OVER v AS g1, sum(d*s2/s0/s0) OVER v AS g2 FROM rs WINDOW v AS (ORDER BY t)),
    u AS (SELECT *, d*(a-s1/s0) - r*(a*h-g1) AS u1, d*(b-s2/s0) - r*(b*h-g2) AS u2 FROM z),
    inf AS MATERIALIZED (SELECT row_id, v11*u1+v12*u2 AS dfbeta FROM u)"""


@query("dfbeta_cox", f"WITH {DFB_COX} SELECT row_id, {srnd('dfbeta', 9)} AS dfbeta FROM inf")
def dfbeta_cox(spark, d):
    f = fx.cohort(spark, d)
    fit = cox.fit_cox(f, "time", "event", ["x_star", "z_bal"])
    out = cox.dfbeta_cox(fit, f, "time", "event", ["x_star", "z_bal"], "row_id")
    return out.select("row_id", rnd("dfbeta_x_star", 9).alias("dfbeta"))


@query("neyman_cox", f"""WITH {DFB_COX}, s AS MATERIALIZED (SELECT row_id, {CROSSED} AS st0, dfbeta AS target FROM cohort JOIN inf USING (row_id)),
    {alloc_sql('target', 'st0', 's', True, '(SELECT floor(count(*)*0.1)::BIGINT FROM cohort)')} {draw_sql('st0', 's', 33)}""")
def neyman_cox(spark, d):
    f, _ = crossed(spark, d)
    f = cut(f.select("row_id", "STRATA", "time", "event", "x_star", "z_bal"))
    data = cox.CoxData(f, "time", "event", ["x_star", "z_bal"], None, (), ["row_id"])
    fit = cox.fit_cox(f, "time", "event", ["x_star", "z_bal"], data=data)
    inf = cox.dfbeta_cox(fit, f, "time", "event", ["x_star", "z_bal"], "row_id", data=data).select("row_id", F.col("dfbeta_x_star").alias("inf"))
    g = cut(f.select("row_id", "STRATA").join(inf, "row_id"))  # the allocation and the draw scan it often
    data.drop()
    out = designs.neyman(g, "STRATA", "inf", "row_id", int(f.count() * 0.1), 33, cap=True)
    return out.select("row_id", F.col("STRATA").alias("strata"), "R", rnd("W").alias("W"))


@query("coef_table_exponentiated", f"WITH {C}, {newton3('yb', 'x_true', 'z_bal', 'binomial', steps=12)} {long_terms([(t, f'exp({e})', s) for t, e, s in GLM_ROWS], 'g12', 5)}")
def coef_table_exponentiated(spark, d):
    out = linear.coef_table(linear.fit_glm(fx.cohort(spark, d), "yb", ["x_true", "z_bal"], "binomial"), exponentiate=True)
    return out.select("term", rnd("estimate", 5).alias("estimate"), rnd("se", 5).alias("se"))


def sandwich3(score: str, src: str, tag: str) -> str:
    """Stratified sandwich for a three-term fit in table ``tag`` with scores score*(1, a, b) by z_seg."""
    return f"""z AS (SELECT z_seg, {score} AS z0, ({score})*x_true AS z1, ({score})*z_bal AS z2 FROM {src}),
    zc AS (SELECT z_seg, count(*) AS nh, covar_samp(z0,z0)*count(*) AS m00, covar_samp(z0,z1)*count(*) AS m01, covar_samp(z0,z2)*count(*) AS m02,
       covar_samp(z1,z1)*count(*) AS m11, covar_samp(z1,z2)*count(*) AS m12, covar_samp(z2,z2)*count(*) AS m22 FROM z GROUP BY 1),
    zm AS (SELECT sum(m00) AS m00, sum(m01) AS m01, sum(m02) AS m02, sum(m11) AS m11, sum(m12) AS m12, sum(m22) AS m22 FROM zc),
    sv AS (SELECT *, i00*(i00*m00+i01*m01+i02*m02)+i01*(i00*m01+i01*m11+i02*m12)+i02*(i00*m02+i01*m12+i02*m22) AS v0,
      i01*(i01*m00+i11*m01+i12*m02)+i11*(i01*m01+i11*m11+i12*m12)+i12*(i01*m02+i11*m12+i12*m22) AS v1,
      i02*(i02*m00+i12*m01+i22*m02)+i12*(i02*m01+i12*m11+i22*m12)+i22*(i02*m02+i12*m12+i22*m22) AS v2 FROM {tag}, zm)"""


SV_ROWS = [("(Intercept)", "b0", "sqrt(v0)"), ("x_true", "b1", "sqrt(v1)"), ("z_bal", "b2", "sqrt(v2)")]
WT = "(1+(row_id % 7)/7.0::DOUBLE)"


@query("fit_survey_glm", f"""WITH {C}, {newton3('yb', 'x_true', 'z_bal', 'binomial', weight=WT, steps=12)}, p AS (SELECT *, 1/(1+exp(-(b0+b1*x_true+b2*z_bal))) AS mu FROM cohort, g12),
    {sandwich3(WT + '*(yb-mu)', 'p', 'g12')} {long_terms(SV_ROWS, 'sv')}""")
def fit_survey_glm(spark, d):
    f = fx.cohort(spark, d).withColumn("W", 1 + (F.col("row_id") % 7) / 7)
    return short(linear.coef_table(linear.fit_survey(f, "yb", ["x_true", "z_bal"], "W", "z_seg", "binomial")))


@query("fit_survey_lm", f"""WITH {C}, {newton3('y', 'x_true', 'z_bal', 'gaussian', weight=WT, steps=2)}, p AS (SELECT *, b0+b1*x_true+b2*z_bal AS mu FROM cohort, g2),
    {sandwich3(WT + '*(y-mu)', 'p', 'g2')} {long_terms(SV_ROWS, 'sv')}""")
def fit_survey_lm(spark, d):
    f = fx.cohort(spark, d).withColumn("W", 1 + (F.col("row_id") % 7) / 7)
    return short(linear.coef_table(linear.fit_survey(f, "y", ["x_true", "z_bal"], "W", "z_seg")))


@query("fit_survey_cox", f"""WITH {C}, {cox2('time', 'event', 'x_true', 'z_bal', weight=WT)},
    r AS (SELECT z_seg, time AS t, event AS d, {WT} AS w, x_true - (SELECT avg(x_true) FROM cohort) AS a, z_bal - (SELECT avg(z_bal) FROM cohort) AS b FROM cohort),
    e AS (SELECT *, exp(b1*a+b2*b) AS r FROM r, c7),
    s AS (SELECT *, sum(w*r) OVER k AS s0, sum(w*r*a) OVER k AS s1, sum(w*r*b) OVER k AS s2 FROM e WINDOW k AS (ORDER BY t DESC)),
    z AS (SELECT *, sum(w*d/s0) OVER v AS h, sum(w*d*s1/s0/s0) OVER v AS g1, sum(w*d*s2/s0/s0) OVER v AS g2 FROM s WINDOW v AS (ORDER BY t)),
    u AS (SELECT *, w*(d*(a-s1/s0) - r*(a*h-g1)) AS z1, w*(d*(b-s2/s0) - r*(b*h-g2)) AS z2 FROM z),
    zm AS (SELECT sum(m11) AS m11, sum(m12) AS m12, sum(m22) AS m22 FROM (SELECT covar_samp(z1,z1)*count(*) AS m11, covar_samp(z1,z2)*count(*) AS m12, covar_samp(z2,z2)*count(*) AS m22 FROM u GROUP BY z_seg)),
    sv AS (SELECT *, v11*(v11*m11+v12*m12)+v12*(v11*m12+v12*m22) AS q1, v12*(v12*m11+v22*m12)+v22*(v12*m12+v22*m22) AS q2 FROM c7, zm)
    {long_terms([('x_true', 'b1', 'sqrt(q1)'), ('z_bal', 'b2', 'sqrt(q2)')], 'sv')}""")
def fit_survey_cox(spark, d):
    f = fx.cohort(spark, d).withColumn("W", 1 + (F.col("row_id") % 7) / 7)
    return short(linear.coef_table(cox.fit_survey_cox(f, "time", "event", ["x_true", "z_bal"], "row_id", "W", "z_seg")))


# ------------------------------------------------------------- pooling and scoring

E = fx.ESTIMATES_SQL
POOLED = "m, q AS estimate, sqrt(u + (1+1/m)*b) AS se, (m-1)*(1+u/((1+1/m)*b))^2 AS df"


@query("pool_rubin", f"""WITH {E}, p AS (SELECT design, method, term, count(*)::DOUBLE AS m, avg(estimate) AS q, avg(se*se) AS u, var_samp(estimate) AS b FROM estimates GROUP BY ALL),
    r AS (SELECT design, method, term, {POOLED}, (1+1/m)*b/u AS r FROM p)
    SELECT design, method, term, m, {srnd('estimate')} AS estimate, {srnd('se')} AS se, {srnd('df', 4)} AS df, {srnd('(r + 2/(df+3))/(r+1)')} AS fmi FROM r""")
def pool_rubin(spark, d):
    p = ev.pool_rubin(fx.estimates(spark, d), ["design", "method", "term"])
    return p.select("design", "method", "term", "m", rnd("estimate").alias("estimate"), rnd("se").alias("se"), rnd("df", 4).alias("df"), rnd("fmi").alias("fmi"))


@query("fit_each", f"""WITH {C} SELECT imp_id, {srnd('regr_slope(y, x_star + imp_id*x_true)')} AS slope FROM cohort, (SELECT unnest([1,2,3]) AS imp_id) GROUP BY 1""")
def fit_each(spark, d):
    f = fx.cohort(spark, d).withColumn("imp_id", F.explode(F.sequence(F.lit(1), F.lit(3))))
    f = f.withColumn("x", F.col("x_star") + F.col("imp_id") * F.col("x_true"))
    return linear.fit_lm(f, "y", ["x"], by=["imp_id"]).table.select("imp_id", rnd(F.col("beta")[1]).alias("slope"))


def true_and_star(spark, d):
    f = fx.cohort(spark, d)
    return f.select("row_id", "x_true", "c_true"), f.select("row_id", F.col("x_star").alias("x_true"), F.col("c_star").alias("c_true"))


@query("standardized_mse", f"WITH {C} SELECT {srnd('avg((x_star-x_true)^2)/var_samp(x_true)')} AS mse FROM cohort")
def standardized_mse(spark, d):
    return ev.standardized_mse(*true_and_star(spark, d), fx.COHORT_ROLES).select(rnd("mse").alias("mse"))


@query("category_error", f"WITH {C} SELECT {srnd('avg((c_star<>c_true)::INTEGER)')} AS error FROM cohort")
def category_error(spark, d):
    return ev.category_error(*true_and_star(spark, d), fx.COHORT_ROLES).select(rnd("error").alias("error"))


# Length of an embedding in the given table.
DIMS = 64


@query("energy_distance", f"""WITH e AS MATERIALIZED (SELECT label % 2 AS s, {', '.join(f'embedding[{i}]::DOUBLE AS v{i}' for i in range(1, DIMS + 1))} FROM embeddings),
    st AS (SELECT {', '.join(f'avg(v{i}) AS m{i}, stddev_samp(v{i}) AS s{i}' for i in range(1, DIMS + 1))} FROM e),
    z AS MATERIALIZED (SELECT s, {', '.join(f'(v{i}-m{i})/s{i} AS z{i}' for i in range(1, DIMS + 1))} FROM e, st),
    p AS (SELECT a.s AS s1, b.s AS s2, avg(sqrt({' + '.join(f'(a.z{i}-b.z{i})^2' for i in range(1, DIMS + 1))})) AS d FROM z a, z b GROUP BY 1, 2)
    SELECT {srnd('greatest(2*max(d) FILTER (WHERE s1=0 AND s2=1) - max(d) FILTER (WHERE s1=0 AND s2=0) - max(d) FILTER (WHERE s1=1 AND s2=1), 0)')} AS energy FROM p""")
def energy_distance(spark, d):
    e = table(spark, d, "embeddings")
    cols = [f"v{i}" for i in range(1, DIMS + 1)]
    v = e.select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    return ev.energy_distance(v.where("label % 2 = 0"), v.where("label % 2 = 1"), cols).select(rnd("energy").alias("energy"))


@query("imputation_loss", f"""WITH {C}, c AS MATERIALIZED (SELECT 0 AS s, x_true AS x, c_true AS c FROM cohort UNION ALL SELECT 1, x_star, c_star FROM cohort),
    st AS (SELECT avg(x) AS m, stddev_samp(x) AS sd FROM c), z AS MATERIALIZED (SELECT s, (x-m)/sd AS z, c FROM c, st),
    p AS (SELECT a.s AS s1, b.s AS s2, avg(sqrt((a.z-b.z)^2 + CASE WHEN a.c=b.c THEN 0 ELSE 2 END)) AS d FROM z a, z b WHERE a.s <= b.s GROUP BY 1, 2),
    k AS (SELECT avg((x_star-x_true)^2)/var_samp(x_true)/2 AS mse, avg((c_star<>c_true)::INTEGER)/2 AS error FROM cohort),
    g AS (SELECT greatest(2*max(d) FILTER (WHERE s1=0 AND s2=1) - max(d) FILTER (WHERE s1=0 AND s2=0) - max(d) FILTER (WHERE s1=1 AND s2=1), 0) AS energy FROM p)
    SELECT {srnd('mse')} AS mse, {srnd('error')} AS error, {srnd('energy')} AS energy, {srnd('mse+error+energy')} AS loss FROM k, g""")
def imputation_loss(spark, d):
    return ev.imputation_loss(*true_and_star(spark, d), fx.COHORT_ROLES).select(*[rnd(c).alias(c) for c in ("mse", "error", "energy", "loss")])


@query("variance_ratio", f"""WITH {C}, o AS (SELECT var_samp(x_true) AS a, var_samp(l) AS b FROM (SELECT x_true, dense_rank() OVER (ORDER BY c_true) AS l FROM cohort)),
    i AS (SELECT avg(a) AS a, avg(b) AS b FROM (SELECT imp_id, var_samp(x) AS a, var_samp(l) AS b FROM
      (SELECT imp_id, x_star*imp_id AS x, dense_rank() OVER (PARTITION BY imp_id ORDER BY c_star) AS l FROM cohort, (SELECT unnest([1,2]) AS imp_id)) GROUP BY 1))
    SELECT 'x_true' AS variable, round(o.a, 4) AS original, round(i.a, 4) AS imputed, round(i.a/o.a, 4) AS ratio FROM o, i
    UNION ALL SELECT 'c_true', round(o.b, 4), round(i.b, 4), round(i.b/o.b, 4) FROM o, i""")
def variance_ratio(spark, d):
    f = fx.cohort(spark, d)
    imp = f.withColumn("imp_id", F.explode(F.sequence(F.lit(1), F.lit(2)))).select(
        "imp_id", (F.col("x_star") * F.col("imp_id")).alias("x_true"), F.col("c_star").alias("c_true"))
    return ev.variance_ratio(f, imp, ["x_true"], ["c_true"])


@query("rmse_by_method", f"""WITH {E} SELECT a.method, a.design, a.term, {srnd('sqrt(avg((a.estimate-b.estimate)^2))')} AS rmse FROM estimates a JOIN estimates b
    ON a.rep=b.rep AND a.design=b.design AND a.term=b.term AND b.method='full' GROUP BY ALL""")
def rmse_by_method(spark, d):
    est = fx.estimates(spark, d)
    return ev.rmse_by_method(est, est.where("method = 'full'"), ["rep", "design", "term"]).withColumn("rmse", rnd("rmse"))


@query("bias_table", f"""WITH {E}, {fx.TRUTH_SQL}, j AS (SELECT *, estimate-truth AS dd FROM estimates JOIN truth USING (term))
    SELECT method, design, term, {srnd('avg(estimate)')} AS mean_estimate, {srnd('avg(dd)')} AS bias, {srnd('100*avg(dd)/any_value(truth)')} AS percent_bias, {srnd('avg(dd)/abs(any_value(truth))')} AS relative_bias, {srnd('quantile_cont(dd, 0.5)')} AS median_diff FROM j GROUP BY ALL""")
def bias_table(spark, d):
    out = ev.bias_table(fx.estimates(spark, d), fx.truth(spark, d))
    return out.select("method", "design", "term", *[rnd(c).alias(c) for c in ("mean_estimate", "bias", "percent_bias", "relative_bias", "median_diff")])


@query("ci_coverage", f"WITH {E}, {fx.TRUTH_SQL} SELECT method, design, term, {srnd('avg((truth BETWEEN lower AND upper)::INTEGER)')} AS coverage FROM estimates JOIN truth USING (term) GROUP BY ALL")
def ci_coverage(spark, d):
    return ev.ci_coverage(fx.estimates(spark, d), fx.truth(spark, d)).withColumn("coverage", rnd("coverage"))


@query("oracle_coverage", f"""WITH {E}, {fx.TRUTH_SQL}, s AS (SELECT *, stddev_samp(estimate) OVER (PARTITION BY method, design, term) AS sd FROM estimates)
    SELECT method, design, term, {srnd('avg((abs(estimate-truth) <= 1.96::DOUBLE*sd)::INTEGER)')} AS coverage FROM s JOIN truth USING (term) GROUP BY ALL""")
def oracle_coverage(spark, d):
    return ev.oracle_coverage(fx.estimates(spark, d), fx.truth(spark, d)).withColumn("coverage", rnd("coverage"))


@query("density_table", f"""WITH {C}, r AS (SELECT min(x_true) AS lo, max(x_true) AS hi, (max(x_true)-min(x_true))/20 AS w FROM cohort),
    v AS (SELECT 'true' AS source, x_true AS v FROM cohort UNION ALL SELECT 'star', x_star FROM cohort),
    k AS (SELECT source, least(floor((v-lo)/w), 19)::INTEGER AS bin, count(*) AS n, any_value(w) AS w FROM v, r WHERE v BETWEEN lo AND hi GROUP BY 1, 2)
    SELECT source, bin, n, {srnd('n/sum(n) OVER (PARTITION BY source)/w')} AS density FROM k""")
def density_table(spark, d):
    f = fx.cohort(spark, d)
    out = ev.density_table({"true": f.select(F.col("x_true").alias("v")), "star": f.select(F.col("x_star").alias("v"))}, "v", 20, "true")
    return out.withColumn("density", rnd("density"))


@query("box_summary", f"""WITH {E} SELECT method, design, term, {', '.join(srnd(f'quantile_cont(estimate, {p})') + ' AS ' + n for n, p in (('minimum', 0.0), ('q1', 0.25), ('median', 0.5), ('q3', 0.75), ('maximum', 1.0)))} FROM estimates GROUP BY ALL""")
def box(spark, d):
    out = box_summary(fx.estimates(spark, d), "estimate", ["method", "design", "term"])
    return out.select("method", "design", "term", *[rnd(c).alias(c) for c in ("minimum", "q1", "median", "q3", "maximum")])


@query("inject_error_continuous", f"""WITH {C}, s AS (SELECT avg(ln(y)) AS m, avg(z_bal) AS z FROM cohort)
    SELECT row_id, {srnd(f"exp(0.2::DOUBLE + 0.9::DOUBLE*(ln(y)-m) + 0.05::DOUBLE*(z_bal-z) + 0.1::DOUBLE*yb + sqrt(0.1::DOUBLE)*{fx.snormal(81, 'y_err', 'row_id')})")} AS y_err FROM cohort, s""")
def inject_error_continuous(spark, d):
    f = fx.cohort(spark, d)
    return ev.inject_error_continuous(f, "y", "y_err", "row_id", 81, 0.9, 0.2, {"z_bal": 0.05, "yb": 0.1}).select("row_id", rnd("y_err").alias("y_err"))


@query("inject_error_category", f"""WITH {C}, s AS (SELECT avg(z_bal) AS m, stddev_samp(z_bal) AS sd FROM cohort),
    o AS (SELECT row_id, c_true, z_bal, list_filter(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'], lambda v: v <> c_true) AS others FROM cohort)
    SELECT row_id, CASE WHEN {fx.skey(82, 'c_err|keep', 'row_id')} > 1/(1+exp(-(ln(0.8/0.2) + 0.3::DOUBLE*(z_bal-m)/sd))) THEN others[floor({fx.skey(82, 'c_err|other', 'row_id')}*4)::INTEGER+1] ELSE c_true END AS c_err FROM o, s""")
def inject_error_category(spark, d):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return ev.inject_error_category(fx.cohort(spark, d), "c_true", "c_err", levels, "row_id", 82, 0.8, {"z_bal": 0.3}).select("row_id", "c_err")
