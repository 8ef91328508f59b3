"""Queries for calibration, imputation, tuning and the end-to-end flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasewise.imputation import chained, draws, error_model, weighted_likelihood
from phasewise.imputation.chained import Target
from phasewise.models import cox, linear
from phasewise.operators import calibration, designs, tuning
from phasewise.operators import evaluation as ev
from phasewise.operators.columns import Roles
from phasewise.plans import draw_sql as ds
from phasewise.plans import fixtures as fx
from phasewise.plans.modelling import cox2, eliminate, long_terms, multinomial_sql, newton3
from phasewise.plans.registry import query, rnd, srnd, table
from phasewise.plans.sampling import cohort
from phasewise.session import cut

C = fx.COHORT_SQL
LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def sampled(spark, d, masked=("x_true", "c_true")):
    """Cohort with a simple validation sample and masked columns."""
    f, n = cohort(spark, d)
    return designs.srs(f, "row_id", n, 1, list(masked))


S_SQL = f"""{C}, s AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY {fx.skey(1, 'srs', 'row_id')}, row_id) <= (SELECT floor(count(*)*0.05)::BIGINT FROM cohort))::INTEGER AS r FROM cohort)"""


# ------------------------------------------------------------- calibration

@query("two_phase", f"WITH {S_SQL} SELECT row_id, {srnd('avg(r) OVER (PARTITION BY z_seg)')} AS prob, {srnd('1/avg(r) OVER (PARTITION BY z_seg)')} AS w FROM s")
def two_phase(spark, d):
    return calibration.two_phase(sampled(spark, d), "z_seg").select("row_id", rnd("prob").alias("prob"), rnd("w").alias("w"))


@query("regression_predict_all", f"""WITH {S_SQL}, p AS (SELECT * FROM s WHERE r = 1), {newton3('x_true', 'x_star', 'z_bal', 'gaussian', 'p', steps=2, tag='a')},
    {newton3('yb', 'x_star', 'z_bal', 'binomial', 'p', steps=12, tag='b')}
    SELECT row_id, {srnd('a2.b0+a2.b1*x_star+a2.b2*z_bal')} AS x_impute, (b12.b0+b12.b1*x_star+b12.b2*z_bal > 0)::INTEGER AS yb_impute FROM s, a2, b12""")
def regression_predict_all(spark, d):
    s = calibration.two_phase(sampled(spark, d))
    out = calibration.regression_predict_all(s, {"x_true": ("gaussian", ["x_star", "z_bal"]), "yb": ("binomial", ["x_star", "z_bal"])})
    return out.select("row_id", rnd("x_true_impute").alias("x_impute"), "yb_impute")


def rake_sql(src, a1, a2, steps=8, w="w"):
    """Newton for exponential-tilt weights on (1, a1, a2); totals over all rows of ``src``."""
    out = [f"""rt AS MATERIALIZED (SELECT count(*)::DOUBLE AS t0, sum({a1}) AS t1, sum({a2}) AS t2 FROM {src}),
      ri AS MATERIALIZED (SELECT {w}::DOUBLE AS w, {a1} AS a, {a2} AS b FROM {src} WHERE r = 1), k0 AS (SELECT 0.0::DOUBLE AS l0, 0.0::DOUBLE AS l1, 0.0::DOUBLE AS l2)"""]
    for k in range(1, steps + 1):
        out.append(f"""k{k} AS MATERIALIZED (SELECT p0+((h11*h22-h12*h12)*g0+(h02*h12-h01*h22)*g1+(h01*h12-h02*h11)*g2)/det AS l0,
          p1+((h02*h12-h01*h22)*g0+(h00*h22-h02*h02)*g1+(h01*h02-h00*h12)*g2)/det AS l1, p2+((h01*h12-h02*h11)*g0+(h01*h02-h00*h12)*g1+(h00*h11-h01*h01)*g2)/det AS l2
          FROM (SELECT *, h00*(h11*h22-h12*h12)-h01*(h01*h22-h12*h02)+h02*(h01*h12-h11*h02) AS det FROM (
            SELECT any_value(l0) AS p0, any_value(l1) AS p1, any_value(l2) AS p2, any_value(t0)-sum(v) AS g0, any_value(t1)-sum(v*a) AS g1, any_value(t2)-sum(v*b) AS g2,
            sum(v) AS h00, sum(v*a) AS h01, sum(v*b) AS h02, sum(v*a*a) AS h11, sum(v*a*b) AS h12, sum(v*b*b) AS h22
            FROM (SELECT *, w*exp(l0+l1*a+l2*b) AS v FROM ri, rt, k{k-1}))))""")
    return ",\n".join(out)


@query("rake", f"""WITH {S_SQL}, q AS (SELECT *, 1/avg(r) OVER () AS w FROM s), {rake_sql('q', 'x_star', 'z_bal')}
    SELECT row_id, {srnd('w*exp(l0+l1*x_star+l2*z_bal)')} AS w_cal FROM q, k8 WHERE r = 1""")
def rake(spark, d):
    s = calibration.two_phase(sampled(spark, d))
    return calibration.rake(s, ["x_star", "z_bal"]).where("R = 1").select("row_id", rnd("w_cal").alias("w_cal"))


@query("raking_totals", f"WITH {C} SELECT count(*)::DOUBLE AS n, {srnd('sum(x_star)', 4)} AS x_star, {srnd('sum(z_bal)', 4)} AS z_bal FROM cohort")
def raking_totals(spark, d):
    s = calibration.rake(calibration.two_phase(sampled(spark, d), "z_seg"), ["x_star", "z_bal"]).where("R = 1")
    w = F.col("w_cal")
    return s.agg(rnd(F.sum(w), 4).alias("n"), rnd(F.sum(w * F.col("x_star")), 4).alias("x_star"), rnd(F.sum(w * F.col("z_bal")), 4).alias("z_bal"))


IMPUTERS = {"x_true": ("gaussian", ["x_star", "z_bal"])}


def raking(spark, d, kind):
    s = sampled(spark, d, ["x_true"])
    y = {"gauss": "y", "bin": "yb", "cox": ("time", "event")}[kind]
    working = {"x": F.col("x_true_impute"), "z": F.col("z_bal")}
    final = {"x": F.col("x_true"), "z": F.col("z_bal")}
    fit = calibration.raking_estimate(s, kind, "row_id", IMPUTERS, working, final, y, strata="z_seg")
    return linear.coef_table(fit)


def rake4_sql(src: str, aux: list[str], steps: int = 9) -> str:
    """Newton for exponential-tilt weights on an intercept and ``aux``."""
    n = len(aux) + 1
    xs = ["1.0::DOUBLE", *aux]
    out = [f"rt AS MATERIALIZED (SELECT {', '.join(f'sum({x}) AS t{i}' for i, x in enumerate(xs))} FROM {src})",
           f"ri AS MATERIALIZED (SELECT w, {', '.join(f'{x} AS a{i}' for i, x in enumerate(xs))} FROM {src} WHERE r = 1)",
           f"k0 AS (SELECT {', '.join(f'0.0::DOUBLE AS l{i}' for i in range(n))})"]
    for k in range(1, steps + 1):
        sums = [f"any_value(l{i}) AS l{i}" for i in range(n)] + [f"any_value(t{i})-sum(v*a{i}) AS g{i}" for i in range(n)]
        sums += [f"sum(v*a{i}*a{j}) AS h{i}_{j}" for i in range(n) for j in range(i, n)]
        inner = f"(SELECT {', '.join(sums)} FROM (SELECT *, w*exp({' + '.join(f'l{i}*a{i}' for i in range(n))}) AS v FROM ri, rt, k{k - 1}))"
        out.append(f"k{k} AS MATERIALIZED (SELECT {', '.join(f'l{i}+x{i} AS l{i}' for i in range(n))} FROM ({eliminate(inner, n)}))")
    return ",\n".join(out)


def raking_sql(y: str, family: str, steps: int) -> str:
    """Prediction model on validated rows, working model on everyone, its influence columns, raking, final fit."""
    mu = "1/(1+exp(-(b0+b1*xi+b2*z_bal)))" if family == "binomial" else "b0+b1*xi+b2*z_bal"
    var = "mu*(1-mu)" if family == "binomial" else "1.0::DOUBLE"
    rows = [f"(i0{j} + i{min(1, j)}{max(1, j)}*xi + i{min(2, j)}{max(2, j)}*z_bal)" for j in range(3)]
    lever = f"({rows[0]} + {rows[1]}*xi + {rows[2]}*z_bal)"
    infl = ", ".join(f"{rows[j]}*({y}-mu)/(1-{var}*{lever})*1e4 AS f{j}" for j in range(3))
    final_mu = "1/(1+exp(-(b0+b1*x_true+b2*z_bal)))" if family == "binomial" else "b0+b1*x_true+b2*z_bal"
    return f"""WITH {S_SQL}, q0 AS MATERIALIZED (SELECT *, 1/avg(r) OVER (PARTITION BY z_seg) AS w FROM s), pv AS (SELECT * FROM q0 WHERE r = 1),
    {newton3('x_true', 'x_star', 'z_bal', 'gaussian', 'pv', 'w', steps=2, tag='a')},
    q1 AS MATERIALIZED (SELECT q0.*, a2.b0+a2.b1*x_star+a2.b2*z_bal AS xi FROM q0, a2),
    {newton3(y, 'xi', 'z_bal', family, 'q1', steps=steps, tag='m')},
    q2 AS MATERIALIZED (SELECT row_id, r, w, z_seg, x_true, z_bal, {y}, {infl} FROM (SELECT *, {mu} AS mu FROM q1, m{steps})),
    {rake4_sql('q2', ['f0', 'f1', 'f2'])},
    fin AS MATERIALIZED (SELECT q2.*, w*exp(l0+l1*f0+l2*f1+l3*f2) AS wc FROM q2, k9 WHERE r = 1),
    {newton3(y, 'x_true', 'z_bal', family, 'fin', 'wc', steps=steps, tag='e')},
    pz AS MATERIALIZED (SELECT wc, w, z_seg, 1.0::DOUBLE AS c0, f0 AS c1, f1 AS c2, f2 AS c3, e AS z0, e*x_true AS z1, e*z_bal AS z2
      FROM (SELECT fin.*, {y} - ({final_mu}) AS e FROM fin, e{steps})),
    {two_phase_sql(3, 4)},
    sv AS (SELECT *, i00*(i00*m00+i01*m01+i02*m02)+i01*(i00*m01+i01*m11+i02*m12)+i02*(i00*m02+i01*m12+i02*m22) AS v0,
      i01*(i01*m00+i11*m01+i12*m02)+i11*(i01*m01+i11*m11+i12*m12)+i12*(i01*m02+i11*m12+i12*m22) AS v1,
      i02*(i02*m00+i12*m01+i22*m02)+i12*(i02*m01+i12*m11+i22*m12)+i22*(i02*m02+i12*m12+i22*m22) AS v2 FROM e{steps}, zm)
    {long_terms([('(Intercept)', 'b0', 'sqrt(v0)'), ('x', 'b1', 'sqrt(v1)'), ('z', 'b2', 'sqrt(v2)')], 'sv', 5)}"""


def two_phase_sql(nz: int, nc: int) -> str:
    """Middle matrix ``zm`` of the two-phase covariance, from ``pz`` (wc, w, z_seg, c0.., z0..)."""
    pairs = [(i, j) for i in range(nz) for j in range(i, nz)]
    out = []
    for i in range(nz):
        sums = [f"sum(w*c{a}*c{b}) AS h{a}_{b}" for a in range(nc) for b in range(a, nc)] + [f"sum(w*c{a}*z{i}) AS g{a}" for a in range(nc)]
        out.append(f"gm{i} AS MATERIALIZED (SELECT {', '.join(f'x{a} AS y{i}_{a}' for a in range(nc))} FROM ({eliminate(f'(SELECT {', '.join(sums)} FROM pz)', nc)}))")
    rest = ", ".join(f"wc*(z{i} - ({' + '.join(f'y{i}_{a}*c{a}' for a in range(nc))})) AS e{i}" for i in range(nz))
    out.append(f"pe AS MATERIALIZED (SELECT *, {rest} FROM pz, {', '.join(f'gm{i}' for i in range(nz))})")
    out.append(f"""ph AS (SELECT z_seg, {', '.join(f'(1 - 1/any_value(w))*covar_samp(e{i}, e{j})*count(*) AS m{i}{j}' for i, j in pairs)} FROM pe GROUP BY 1)""")
    out.append(f"p1 AS (SELECT {', '.join(f'nn/(nn-1)*(q{i}{j} - s{i}*s{j}/nn) AS l{i}{j}' for i, j in pairs)} FROM (SELECT sum(w) AS nn, {', '.join(f'sum(wc*z{i}) AS s{i}' for i in range(nz))}, {', '.join(f'sum(wc*z{i}*z{j}) AS q{i}{j}' for i, j in pairs)} FROM pz))")
    out.append(f"zm AS (SELECT {', '.join(f'any_value(l{i}{j}) + sum(m{i}{j}) AS m{i}{j}' for i, j in pairs)} FROM ph, p1)")
    return ",\n    ".join(out)


def short5(df):
    return df.select("term", rnd("estimate", 5).alias("estimate"), rnd("se", 5).alias("se"))


@query("raking_estimate_gauss", raking_sql("y", "gaussian", 2))
def raking_estimate_gauss(spark, d):
    return short5(raking(spark, d, "gauss"))


@query("raking_estimate_bin", raking_sql("yb", "binomial", 12))
def raking_estimate_bin(spark, d):
    return short5(raking(spark, d, "bin"))


def cox_scores(src: str, fit: str, x: str, z: str, keep: str, weight: str = "1.0::DOUBLE", tag: str = "u") -> str:
    """Score residuals <tag>1, <tag>2 of the two-term Cox fit in table ``fit``, in table <tag>."""
    return f"""{tag}r AS (SELECT {keep}, time AS t, event AS d, {weight} AS cw, {x} - (SELECT avg({x}) FROM {src}) AS a, {z} - (SELECT avg({z}) FROM {src}) AS b FROM {src}),
    {tag}e AS (SELECT *, exp(b1*a+b2*b) AS rr FROM {tag}r, {fit}),
    {tag}s AS (SELECT *, sum(cw*rr) OVER k AS s0, sum(cw*rr*a) OVER k AS s1, sum(cw*rr*b) OVER k AS s2 FROM {tag}e WINDOW k AS (ORDER BY t DESC)),
    {tag}z AS (SELECT *, sum(cw*d/s0) OVER v AS hz, sum(cw*d*s1/s0/s0) OVER v AS g1, sum(cw*d*s2/s0/s0) OVER v AS g2 FROM {tag}s WINDOW v AS (ORDER BY t)),
    {tag} AS MATERIALIZED (SELECT *, d*(a-s1/s0) - rr*(a*hz-g1) AS {tag}1, d*(b-s2/s0) - rr*(b*hz-g2) AS {tag}2 FROM {tag}z)"""


RAKE_COX = f"""WITH {S_SQL}, q0 AS MATERIALIZED (SELECT *, 1/avg(r) OVER (PARTITION BY z_seg) AS w FROM s), pv AS (SELECT * FROM q0 WHERE r = 1),
    {newton3('x_true', 'x_star', 'z_bal', 'gaussian', 'pv', 'w', steps=2, tag='a')},
    q1 AS MATERIALIZED (SELECT q0.*, a2.b0+a2.b1*x_star+a2.b2*z_bal AS xi FROM q0, a2),
    {cox2('time', 'event', 'xi', 'z_bal', 'q1', tag='m')},
    {cox_scores('q1', 'm7', 'xi', 'z_bal', 'row_id, r, w, z_seg, x_true, z_bal, time, event', tag='u')},
    q2 AS MATERIALIZED (SELECT row_id, r, w, z_seg, x_true, z_bal, time, event, (v11*u1+v12*u2)*1e4 AS f0, (v12*u1+v22*u2)*1e4 AS f1 FROM u),
    {rake4_sql('q2', ['f0', 'f1'])},
    fin AS MATERIALIZED (SELECT q2.*, w*exp(l0+l1*f0+l2*f1) AS wc FROM q2, k9 WHERE r = 1),
    {cox2('time', 'event', 'x_true', 'z_bal', 'fin', tag='e', weight='wc')},
    {cox_scores('fin', 'e7', 'x_true', 'z_bal', 'w, wc, z_seg, f0, f1', 'wc', tag='n')},
    pz AS MATERIALIZED (SELECT wc, w, z_seg, 1.0::DOUBLE AS c0, f0 AS c1, f1 AS c2, n1 AS z0, n2 AS z1 FROM n),
    {two_phase_sql(2, 3)},
    sv AS (SELECT *, v11*(v11*m00+v12*m01)+v12*(v11*m01+v12*m11) AS v0, v12*(v12*m00+v22*m01)+v22*(v12*m01+v22*m11) AS v1 FROM e7, zm)
    {long_terms([('x', 'b1', 'sqrt(v0)'), ('z', 'b2', 'sqrt(v1)')], 'sv', 5)}"""


@query("raking_estimate_cox", RAKE_COX)
def raking_estimate_cox(spark, d):
    return short5(raking(spark, d, "cox"))


# ------------------------------------------------------------- imputation

@query("select_predictors", f"""WITH {S_SQL}, v AS (SELECT CASE WHEN r=1 THEN x_true END AS x, x_star AS s, z_bal AS z, CASE WHEN r=1 THEN 0.0 ELSE 1.0 END AS mx FROM s),
    k AS (SELECT 'x_true' AS target, 'x_star' AS predictor, greatest(abs(corr(x,s)), abs(corr(mx,s))) AS c FROM v UNION ALL SELECT 'x_true','z_bal',greatest(abs(corr(x,z)), abs(corr(mx,z))) FROM v
      UNION ALL SELECT 'x_star','x_true',abs(corr(s,x)) FROM v UNION ALL SELECT 'x_star','z_bal',abs(corr(s,z)) FROM v UNION ALL SELECT 'z_bal','x_true',abs(corr(z,x)) FROM v UNION ALL SELECT 'z_bal','x_star',abs(corr(z,s)) FROM v)
    SELECT target, predictor, {srnd('c')} AS correlation, c >= 0.1 OR (target = 'x_true' AND predictor = 'z_bal') AS used FROM k""")
def select_predictors(spark, d):
    out = chained.select_predictors(sampled(spark, d), ["x_true", "x_star", "z_bal"], 0.1, {"x_true": ["z_bal"]})
    return out.select("target", "predictor", rnd("correlation").alias("correlation"), "used")


@query("retry_collinear", f"WITH {C} SELECT unnest(['x_star', 'z_bal']) AS predictor FROM (SELECT 1 FROM cohort LIMIT 1)")
def retry_collinear(spark, d):
    # A constant column makes the first fit singular; raising the threshold drops it.
    f = fx.cohort(spark, d).select("x_true", "x_star", "z_bal")
    f = f.withColumn("dull", F.lit(0.0) * F.col("z_bal"))
    used, _ = chained.retry_collinear(f, "x_true", ["x_star", "z_bal", "dull"], 0.0, 1e-9)
    return spark.createDataFrame([(u,) for u in used], "predictor string")


def chain_targets():
    return {
        "x_true": Target("norm", {"x_star": F.col("x_star"), "z_bal": F.col("z_bal"), "y": F.col("y")}),
        "c_true": Target("multiclass", {"med": (F.col("c_star") == "3-MEDIUM").cast("double"), "x": F.col("x_true") - 12}, LEVELS),
    }


NORM_XS = ["1", "x_star", "z_bal", "y"]
CHAIN_XS = ["1", "(c_star = '3-MEDIUM')::INTEGER", "x_true - 12"]
CHAIN_M, CHAIN_SWEEPS = 5, 4


def class_sql(rows: str, fit: str, xs, seed, draw: str, keep: str, levels=LEVELS) -> str:
    """``rows`` with a multinomial draw ``cls`` from the five-level fit in table ``fit``."""
    p = len(xs)
    etas = ["0.0::DOUBLE"] + [" + ".join(f"b{c * p + i}*({x})" for i, x in enumerate(xs)) for c in range(len(levels) - 1)]
    upto = lambda c: f"({' + '.join(f'e{i}' for i in range(c + 1))})/tot"
    cases = " ".join(f"WHEN u < {upto(c)} THEN '{v}'" for c, v in enumerate(levels[:-1]))
    return f"""SELECT {keep}, CASE {cases} ELSE '{levels[-1]}' END AS cls FROM (SELECT *, {' + '.join(f'e{c}' for c in range(len(levels)))} AS tot
      FROM (SELECT t.*, {fx.skey(seed, f'{draw}|u', 'imp_id', 'row_id')} AS u, {', '.join(f'exp({e}) AS e{c}' for c, e in enumerate(etas))} FROM {rows} t, {fit}))"""


# Both targets are known on the same rows, so every sweep fits the same rows; the last sweep's draws stay.
CHAIN_SQL = f"""{ds.draw_norm_sql('pa', 's', 'x_true', NORM_XS, 5, f'sweep{CHAIN_SWEEPS}|x_true', CHAIN_M)},
    {multinomial_sql('c_true', LEVELS, CHAIN_XS, '(SELECT * FROM s WHERE r = 1)', 9)},
    filled AS MATERIALIZED (SELECT imp_id, row_id, r, c_star, c_true, CASE WHEN r = 1 THEN x_true ELSE {ds.drawn(NORM_XS, 5, f'sweep{CHAIN_SWEEPS}|x_true')} END AS x_true FROM s, pap)"""


@query("chained_equations", f"""WITH {S_SQL}, {CHAIN_SQL} SELECT imp_id, row_id, {srnd('x_true')} AS x_true, CASE WHEN r = 1 THEN c_true ELSE cls END AS c_true
    FROM ({class_sql('filled', 'q9', CHAIN_XS, 5, f'sweep{CHAIN_SWEEPS}|c_true', 'imp_id, row_id, r, x_true, c_true')})""")
def chained_equations(spark, d):
    out = chained.chained_equations(sampled(spark, d), chain_targets(), "row_id", m=CHAIN_M, maxit=CHAIN_SWEEPS, seed=5)
    return out.select("imp_id", "row_id", rnd("x_true").alias("x_true"), "c_true")


@query("draw_norm", f"""WITH {S_SQL}, {ds.draw_norm_sql('pa', 's', 'x_true', NORM_XS, 6, 'once|x_true', 3)}
    SELECT imp_id, row_id, {srnd(f"CASE WHEN r = 1 THEN x_true ELSE {ds.drawn(NORM_XS, 6, 'once|x_true')} END")} AS x_true FROM s, pap""")
def draw_norm(spark, d):
    out = chained.impute_fixed(sampled(spark, d), {"x_true": chain_targets()["x_true"]}, "row_id", 3, 6)
    return out.select("imp_id", "row_id", rnd("x_true").alias("x_true"))


@query("draw_pmm", f"""WITH {S_SQL}, don AS MATERIALIZED (SELECT row_id AS donor, x_star AS p, x_true AS v, row_number() OVER (ORDER BY x_star, row_id) AS rk FROM s WHERE r=1),
    al AS (SELECT row_id, x_star AS p, r, count(*) FILTER (WHERE r=1) OVER (ORDER BY x_star, row_id) AS pos FROM s),
    cand AS (SELECT a.imp_id, a.row_id, d.p AS dp, d.donor, abs(d.p-a.p) AS dist FROM (SELECT imp_id, row_id, p, unnest(range(pos-9, pos+11)) AS rk FROM al, (SELECT unnest([1,2]) AS imp_id) WHERE r=0) a JOIN don d USING (rk)),
    rn AS (SELECT *, row_number() OVER (PARTITION BY imp_id, row_id ORDER BY dist, dp, donor) AS n FROM cand),
    ch AS (SELECT imp_id, row_id, dp, {fx.skey(9, 'once|x_true|tie', 'imp_id', 'row_id')} AS tie FROM rn WHERE n = floor({fx.skey(9, 'once|x_true|pick', 'imp_id', 'row_id')}*5)+1),
    num AS (SELECT imp_id, p, v, count(*) OVER (PARTITION BY imp_id, p) AS size,
      row_number() OVER (PARTITION BY imp_id, p ORDER BY floor({fx.skey(9, 'once|x_true|salt', 'imp_id', 'donor')}*64), donor) AS place FROM don, (SELECT unnest([1,2]) AS imp_id))
    SELECT ch.imp_id, row_id, {srnd('v')} AS x_true FROM ch JOIN num ON num.imp_id = ch.imp_id AND p = dp AND place = floor(tie*size)+1
    UNION ALL SELECT imp_id, row_id, {srnd('x_true')} FROM s, (SELECT unnest([1,2]) AS imp_id) WHERE r=1""")
def draw_pmm(spark, d):
    """Donor matching on a given prediction (the surrogate)."""
    s = draws.stack_copies(sampled(spark, d).withColumn("_miss_x_true", F.col("x_true").isNull()), 2)
    out = draws.match_donors(s, "x_true", "x_star", "_miss_x_true", "row_id", 9, "once")
    return out.select("imp_id", "row_id", rnd("x_true").alias("x_true"))


def donors_sql(seed, tag: str, target: str, k: int = 5, reach: int = 10) -> str:
    """<ch> (imp_id, row_id, dv): a draw among the k nearest of ``don`` (imp_id, donor, p, v) for every row of ``rec`` (imp_id, row_id, p)."""
    return f"""dn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY imp_id ORDER BY p, donor) AS rk FROM don),
    al AS (SELECT imp_id, row_id, p, pos FROM (SELECT imp_id, row_id, p, d, count(*) FILTER (WHERE d = 0) OVER (PARTITION BY imp_id ORDER BY p, d) AS pos
      FROM (SELECT imp_id, donor AS row_id, p, 0 AS d FROM don UNION ALL SELECT imp_id, row_id, p, 1 FROM rec)) WHERE d = 1),
    cand AS (SELECT a.imp_id, a.row_id, d.p AS dp, d.donor, abs(d.p-a.p) AS dist FROM (SELECT imp_id, row_id, p, unnest(range(pos-{reach - 1}, pos+{reach + 1})) AS rk FROM al) a JOIN dn d USING (imp_id, rk)),
    rn AS (SELECT *, row_number() OVER (PARTITION BY imp_id, row_id ORDER BY dist, dp, donor) AS n FROM cand),
    pk AS (SELECT imp_id, row_id, dp, {fx.skey(seed, f'{tag}|{target}|tie', 'imp_id', 'row_id')} AS tie FROM rn WHERE n = floor({fx.skey(seed, f'{tag}|{target}|pick', 'imp_id', 'row_id')}*{k})+1),
    num AS (SELECT imp_id, p, v, count(*) OVER (PARTITION BY imp_id, p) AS size,
      row_number() OVER (PARTITION BY imp_id, p ORDER BY floor({fx.skey(seed, f'{tag}|{target}|salt', 'imp_id', 'donor')}*64), donor) AS place FROM don),
    ch AS MATERIALIZED (SELECT pk.imp_id, row_id, v AS dv FROM pk JOIN num ON num.imp_id = pk.imp_id AND p = dp AND place = floor(tie*size)+1)"""


_PMM_XS = ["1", "x_star", "y"]


@query("draw_pmm_chain", f"""WITH {S_SQL}, {ds.draw_norm_sql('pa', 's', 'x_true', _PMM_XS, 7, 'once|x_true', 2)},
    don AS MATERIALIZED (SELECT imp_id, row_id AS donor, b0 + b1*x_star + b2*y AS p, x_true AS v FROM s, paf, {ds.imps_sql(2)} WHERE r = 1),
    rec AS MATERIALIZED (SELECT imp_id, row_id, t0 + t1*x_star + t2*y AS p FROM s, pap WHERE r = 0), {donors_sql(7, 'once', 'x_true')}
    SELECT imp_id, row_id, {srnd('dv')} AS x_true FROM ch UNION ALL SELECT imp_id, row_id, {srnd('x_true')} FROM s, {ds.imps_sql(2)} WHERE r = 1""")
def draw_pmm_chain(spark, d):
    t = {"x_true": Target("pmm", {"x_star": F.col("x_star"), "y": F.col("y")})}
    s = cut(sampled(spark, d).select("row_id", "x_true", "x_star", "y"))
    return chained.impute_fixed(s, t, "row_id", 2, 7).select("imp_id", "row_id", rnd("x_true").alias("x_true"))


@query("draw_binary", f"""WITH {S_SQL}, {ds.logit_sql('pa', '(SELECT * FROM s WHERE r = 1)', 'yb', ['1', 'x_star'])}, {ds.posterior_sql('pa', 2, 8, 'once|yb', 2, linear=False)}
    SELECT imp_id, row_id, CASE WHEN r = 1 THEN yb ELSE ({fx.skey(8, 'once|yb|u', 'imp_id', 'row_id')} < 1/(1+exp(-(t0 + t1*x_star))))::INTEGER END AS yb FROM s, pap""")
def draw_binary(spark, d):
    s = sampled(spark, d, ["yb"])
    return chained.impute_fixed(s, {"yb": Target("binary", {"x_star": F.col("x_star")})}, "row_id", 2, 8).select("imp_id", "row_id", "yb")


CLASS_XS = ["1", "(c_star = '3-MEDIUM')::INTEGER", "x_star - 12"]
_ETA = ["0.0::DOUBLE"] + [" + ".join(f"b{c * 3 + i}*({x})" for i, x in enumerate(CLASS_XS)) for c in range(4)]


@query("draw_multiclass", f"""WITH {S_SQL}, {multinomial_sql('c_true', LEVELS, CLASS_XS, '(SELECT * FROM s WHERE r = 1)', 9)},
    e AS (SELECT s.*, imp_id, {fx.skey(8, 'once|c_true|u', 'imp_id', 'row_id')} AS u, {', '.join(f'exp({x}) AS e{c}' for c, x in enumerate(_ETA))} FROM s, q9, {ds.imps_sql(2)}),
    k AS (SELECT *, e0+e1+e2+e3+e4 AS tot FROM e)
    SELECT imp_id, row_id, CASE WHEN r = 1 THEN c_true WHEN u < e0/tot THEN '{LEVELS[0]}' WHEN u < (e0+e1)/tot THEN '{LEVELS[1]}' WHEN u < (e0+e1+e2)/tot THEN '{LEVELS[2]}'
      WHEN u < (e0+e1+e2+e3)/tot THEN '{LEVELS[3]}' ELSE '{LEVELS[4]}' END AS c_true FROM k""")
def draw_multiclass(spark, d):
    t = {"c_true": Target("multiclass", {"med": (F.col("c_star") == "3-MEDIUM").cast("double"), "x": F.col("x_star") - 12}, LEVELS)}
    return chained.impute_fixed(sampled(spark, d), t, "row_id", 2, 8).select("imp_id", "row_id", "c_true")


@query("draw_forest")
def draw_forest(spark, d):
    t = {"x_true": Target("forest", {"x_star": 0, "z_bal": 0, "c_star": 0}, None, {"numTrees": 10, "maxDepth": 5})}
    return chained.impute_fixed(sampled(spark, d), t, "row_id", 5, 8).select("imp_id", "row_id", rnd("x_true").alias("x_true"))


@query("draw_boosted")
def draw_boosted(spark, d):
    t = {"x_true": Target("boosted", {"x_star": 0, "z_bal": 0}, None, {"maxIter": 6, "maxDepth": 3})}
    return chained.impute_fixed(sampled(spark, d), t, "row_id", 5, 8).select("imp_id", "row_id", rnd("x_true").alias("x_true"))


SPLITS, ALLOC = (11.5, 12.3), (0.3, 0.05, 0.3)


def outcome_sample(spark, d):
    f = fx.cohort(spark, d)
    from phasewise.functions.keyed import uniform

    p = F.when(F.col("x_true") <= SPLITS[0], ALLOC[0]).when(F.col("x_true") >= SPLITS[1], ALLOC[2]).otherwise(ALLOC[1])
    f = f.withColumn("R", (uniform(17, "pick", "row_id") < p).cast("int"))
    return f.withColumn("x_true", F.when(F.col("R") == 1, F.col("x_true")))


OUT_SQL = f"""{C}, w AS MATERIALIZED (SELECT *, ({fx.skey(17, 'pick', 'row_id')} < CASE WHEN x_true <= {SPLITS[0]} THEN {ALLOC[0]} WHEN x_true >= {SPLITS[1]} THEN {ALLOC[2]} ELSE {ALLOC[1]} END)::INTEGER AS r FROM cohort),
    {ds.weighted_likelihood_sql('pw', '(SELECT * FROM w WHERE r = 1)', 'x_true', 'x_star', SPLITS, ALLOC)}"""


@query("fit_weighted_likelihood", f"""WITH {OUT_SQL} SELECT unnest(['(Intercept)', 'x_star', 'log_sigma']) AS term, unnest([{srnd('b0')}, {srnd('b1')}, {srnd('ls')}]) AS estimate FROM pwf""")
def fit_weighted_likelihood(spark, d):
    fit = weighted_likelihood.fit_weighted_likelihood(outcome_sample(spark, d).where("R = 1"), "x_true", ["x_star"], SPLITS, ALLOC)
    rows = list(zip(fit.terms, fit.beta)) + [("log_sigma", fit.log_sigma)]
    return spark.createDataFrame([(t, float(v)) for t, v in rows], "term string, estimate double").select("term", rnd("estimate").alias("estimate"))


_WL = "weighted_likelihood|x_true"
_WL_ROWS = "(SELECT imp_id, row_id, r, x_true, sd, sigma, t0 + t1*x_star AS mu FROM w, pwp)"
_WL_LAW = ds.unselected_sql(_WL_ROWS, SPLITS, ALLOC, fx.skey(18, f"{_WL}|bin", "imp_id", "row_id"), fx.skey(18, f"{_WL}|in", "imp_id", "row_id"))
_WL_DRAW = ds.weighted_likelihood_draw_sql("pw", 18, _WL, 2)


@query("draw_weighted_likelihood_sampling", f"""WITH {OUT_SQL}, {_WL_DRAW} SELECT imp_id, row_id, {srnd('CASE WHEN r = 1 THEN x_true ELSE ud END')} AS x_true FROM ({_WL_LAW})""")
def draw_weighted_likelihood_sampling(spark, d):
    out = weighted_likelihood.impute_weighted_likelihood(outcome_sample(spark, d), "x_true", ["x_star"], SPLITS, ALLOC, "row_id", 2, 18)
    return out.select("imp_id", "row_id", rnd("x_true").alias("x_true"))


@query("draw_weighted_likelihood_integration", f"""WITH {OUT_SQL}, {_WL_DRAW} SELECT imp_id, row_id,
    {srnd(f"CASE WHEN r = 1 THEN x_true ELSE um + sd*{fx.snormal(18, f'{_WL}|e', 'imp_id', 'row_id')} END")} AS x_true FROM ({_WL_LAW})""")
def draw_weighted_likelihood_integration(spark, d):
    out = weighted_likelihood.impute_weighted_likelihood(outcome_sample(spark, d), "x_true", ["x_star"], SPLITS, ALLOC, "row_id", 2, 18, "integration")
    return out.select("imp_id", "row_id", rnd("x_true").alias("x_true"))


@query("draw_weighted_likelihood_published", f"""WITH {OUT_SQL}, {_WL_DRAW} SELECT imp_id, row_id,
    {srnd(f"CASE WHEN r = 1 THEN x_true ELSE mu + sigma*{fx.snormal(18, f'{_WL}|e', 'imp_id', 'row_id')} END")} AS x_true FROM {_WL_ROWS}""")
def draw_weighted_likelihood_published(spark, d):
    """The acceptance rule as published, which takes every proposal."""
    out = weighted_likelihood.impute_weighted_likelihood(outcome_sample(spark, d), "x_true", ["x_star"], SPLITS, ALLOC, "row_id", 2, 18, acceptance="as_published")
    return out.select("imp_id", "row_id", rnd("x_true").alias("x_true"))


_WLC = "sweep3|x_true"
_WLC_LAW = ds.unselected_sql("(SELECT imp_id, row_id, r, x_true, yb, sigma, t0 + t1*x_star AS mu FROM w, pwp)", SPLITS, ALLOC,
                             fx.skey(21, f"{_WLC}|bin", "imp_id", "row_id"), fx.skey(21, f"{_WLC}|in", "imp_id", "row_id"))


@query("chained_weighted_likelihood", f"""WITH {OUT_SQL}, {ds.weighted_likelihood_draw_sql('pw', 21, _WLC, 5)},
    x AS MATERIALIZED (SELECT imp_id, row_id, r, yb, CASE WHEN r = 1 THEN x_true ELSE ud END AS xt FROM ({_WLC_LAW})),
    {ds.logit_sql('pb', '(SELECT * FROM w WHERE r = 1)', 'yb', ['1', 'x_true - 12'])}, {ds.posterior_sql('pb', 2, 21, 'sweep3|yb', 5, linear=False)}
    SELECT imp_id, row_id, {srnd('xt')} AS x_true, CASE WHEN r = 1 THEN yb ELSE ({fx.skey(21, 'sweep3|yb|u', 'imp_id', 'row_id')} < 1/(1+exp(-(t0 + t1*(xt - 12)))))::INTEGER END AS yb
    FROM x JOIN pbp USING (imp_id)""")
def chained_weighted_likelihood(spark, d):
    """Chains whose exposure is drawn by the selection-corrected regression, the outcome by a logit on it."""
    s = outcome_sample(spark, d).withColumn("yb", F.when(F.col("R") == 1, F.col("yb")))
    targets = {
        "x_true": Target("weighted_likelihood", {"x_star": F.col("x_star")}, None, {"splits": SPLITS, "alloc": ALLOC}),
        "yb": Target("binary", {"x": F.col("x_true") - 12}),
    }
    out = chained.chained_equations(s, targets, "row_id", m=5, maxit=3, seed=21)
    return out.select("imp_id", "row_id", rnd("x_true").alias("x_true"), "yb")


_RES_XS = ["1", "x_star", "z_bal", "y"]
_CAT_XS = ["1", "z_bal"]
_CAT_U = fx.skey(19, "cat|c_true|u", "imp_id", "row_id")
_UPTO = ["(" + " + ".join(f"w{i}" for i in range(c + 1)) + ")" for c in range(5)]
ERROR_MODEL = f"""{ds.draw_norm_sql('pa', '(SELECT *, x_star - x_true AS res FROM s)', 'res', _RES_XS, 19, 'resid|x_true|_res', 2)},
    l AS (SELECT DISTINCT c_true AS v FROM s WHERE r = 1 UNION SELECT DISTINCT c_star FROM s WHERE r = 1),
    n AS (SELECT c_star AS given, c_true AS level, count(*) AS n FROM s WHERE r = 1 GROUP BY ALL),
    q AS MATERIALIZED (SELECT given, {', '.join(f"max(CASE WHEN level = '{v}' THEN prob END) AS q{c}" for c, v in enumerate(LEVELS))} FROM (
      SELECT g.v AS given, e.v AS level, (coalesce(n, 0) + 1)/sum(coalesce(n, 0) + 1) OVER (PARTITION BY g.v) AS prob FROM l g CROSS JOIN l e LEFT JOIN n ON n.given = g.v AND n.level = e.v) GROUP BY 1),
    sh AS (SELECT {', '.join(f"greatest(count(*) FILTER (c_true = '{v}'), 0.5)/count(*) AS s{c}" for c, v in enumerate(LEVELS))} FROM s WHERE r = 1),
    {multinomial_sql('c_true', LEVELS, _CAT_XS, '(SELECT * FROM s WHERE r = 1)', 9, 'mq')},
    ex AS (SELECT imp_id, row_id, r, c_true, x_true, x_star - ({ds.drawn(_RES_XS, 19, 'resid|x_true|_res')}) AS xd, {_CAT_U} AS u,
      {', '.join(f'coalesce(q{c}, s{c})*exp({e})/s{c} AS w{c}' for c, e in enumerate(['0.0::DOUBLE'] + [f'b{2 * c} + b{2 * c + 1}*z_bal' for c in range(4)]))}
      FROM s CROSS JOIN pap CROSS JOIN sh CROSS JOIN mq9 LEFT JOIN q ON q.given = s.c_star)"""


@query("error_model_impute", f"""WITH {S_SQL}, {ERROR_MODEL} SELECT imp_id, row_id, {srnd('CASE WHEN r = 1 THEN x_true ELSE xd END')} AS x_true,
    CASE WHEN r = 1 THEN c_true {' '.join(f"WHEN u < {_UPTO[c]}/{_UPTO[4]} THEN '{v}'" for c, v in enumerate(LEVELS[:-1]))} ELSE '{LEVELS[-1]}' END AS c_true FROM ex""")
def error_model_impute(spark, d):
    out = error_model.error_model_impute(sampled(spark, d), fx.COHORT_ROLES, 2, 19, {"z_bal": F.col("z_bal"), "y": F.col("y")},
                                         {"z_bal": F.col("z_bal")}, {"c_true": LEVELS})
    return out.select("imp_id", "row_id", rnd("x_true").alias("x_true"), "c_true")


def _redraw_sql(mean: str, sd: float, lo: float, hi: float, seed, tag: str, target: str, m: int) -> str:
    """<gen> (imp_id, row_id, r, x_true, g): the first accepted of six draws of every row, else the last."""
    def value(a):
        return f"({mean} + {sd}::DOUBLE*{fx.snormal(seed, f'{tag}|{target}|{a}', 'imp_id', 'row_id')})"

    cases = " ".join(
        f"WHEN {fx.skey(seed, f'{tag}|accept|{a}', 'imp_id', 'row_id')} < exp(0 - pow(greatest(g{a} - {hi}, {lo} - g{a}, 0)/{(hi - lo) / 2!r}, 2)) THEN g{a}" for a in range(6))
    return f"gen AS MATERIALIZED (SELECT imp_id, row_id, r, x_true, CASE {cases} ELSE g5 END AS g FROM (SELECT s.*, imp_id, {', '.join(f'{value(a)} AS g{a}' for a in range(6))} FROM s, {ds.imps_sql(m)}))"


@query("redraw_out_of_range", f"""WITH {S_SQL}, {_redraw_sql('x_star', 0.5, 10.5, 12.8, 20, 'range', 'x_true', 2)},
    don AS MATERIALIZED (SELECT imp_id, row_id AS donor, g AS p, x_true AS v FROM gen WHERE r = 1),
    rec AS MATERIALIZED (SELECT imp_id, row_id, g AS p FROM gen WHERE r = 0 AND (g < 10.5 OR g > 12.8)), {donors_sql(20, 'range', 'x_true')}
    SELECT imp_id, row_id, {srnd('CASE WHEN r = 1 THEN x_true ELSE coalesce(dv, g) END')} AS x_true FROM gen LEFT JOIN ch USING (imp_id, row_id)""")
def redraw_out_of_range(spark, d):
    s = draws.stack_copies(sampled(spark, d).withColumn("_miss", F.col("x_true").isNull()), 2)
    out = error_model.redraw_out_of_range(s, {"x_true": (F.col("x_star"), F.lit(0.5))}, {"x_true": (10.5, 12.8)}, "_miss", "row_id", 20)
    return out.select("imp_id", "row_id", rnd("x_true").alias("x_true"))


@query("fill_missing", f"""WITH {S_SQL} SELECT row_id, imp_id, {srnd('CASE WHEN r=1 THEN x_true ELSE x_star*imp_id END')} AS x_true FROM s, (SELECT unnest([1,2,3]) AS imp_id)""")
def fill_missing(spark, d):
    s = sampled(spark, d).select("row_id", "x_true", "x_star")
    dr = draws.stack_copies(s, 3).select("row_id", "imp_id", (F.col("x_star") * F.col("imp_id")).alias("x_true"))
    return draws.fill_missing(s, dr, "row_id", ["x_true"]).select("row_id", "imp_id", rnd("x_true").alias("x_true"))


# ------------------------------------------------------------- tuning

GRID = {"rate": ("log", 1e-4, 1e-1), "depth": ("int", 2, 8), "width": ("pow2", 4, 9), "drop": ("step", 0.0, 0.5, 0.1), "mix": ("float", -1.0, 1.0), "norm": ("choice", ["zscore", "quantile", "spline"])}


def gu(n):
    return fx.skey(91, n, "p_partkey")


@query("search_space", f"""SELECT p_partkey, {srnd(f"exp(ln(1e-4)+{gu('rate')}*(ln(1e-1)-ln(1e-4)))", 9)} AS rate, (2+floor({gu('depth')}*7))::INTEGER AS depth, (2^(4+floor({gu('width')}*6)))::INTEGER AS width,
    {srnd(f"floor({gu('drop')}*6)*0.1::DOUBLE")} AS "drop", {srnd(f"-1.0::DOUBLE+{gu('mix')}*2.0::DOUBLE")} AS mix, (['zscore','quantile','spline'])[floor({gu('norm')}*3)::INTEGER+1] AS norm FROM part""")
def search_space(spark, d):
    out = tuning.search_space(table(spark, d, "part"), "p_partkey", GRID, 91)
    return out.withColumns({"rate": rnd("rate", 9), "drop": rnd("drop"), "mix": rnd("mix")})


@query("masked_cv_score")
def masked_cv_score(spark, d):
    roles = Roles("row_id", (("x_star", "x_true"),), ("x_true", "x_star"))
    terms = {"x_star": F.col("x_star"), "y": F.col("y")}
    out = tuning.masked_cv_score(fx.cohort(spark, d).select("row_id", "x_star", "x_true", "y"), roles,
                                 lambda s: draws.draw_norm(s, "x_true", terms, "_miss_x_true", "row_id", 4, "cv"), 4, 2, 3)
    return out.select("trial", "fold", rnd("mse").alias("mse"), rnd("error").alias("error"))


_CV_LINES = {1: (2.0, 0.8), 2: (1.0, 0.9)}
_CV_GROUPS = "trial, fold"


@query("masked_cv_scores", f"""WITH {C}, o AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY {fx.skey(3, 'fold', 'row_id')}, row_id) - 1) % 12 AS fold FROM cohort),
    t AS (SELECT unnest([1, 2]) AS trial, unnest([2.0, 1.0])::DOUBLE AS a, unnest([0.8, 0.9])::DOUBLE AS b),
    r AS MATERIALIZED (SELECT trial, fold, x_true, a + b*x_star AS xi, c_true, c_star AS ci FROM o, t),
    s AS (SELECT {_CV_GROUPS}, 0 AS s, x_true AS x, c_true AS c FROM r UNION ALL SELECT {_CV_GROUPS}, 1, xi, ci FROM r),
    st AS (SELECT {_CV_GROUPS}, avg(x) AS m, stddev_samp(x) AS sd FROM s GROUP BY ALL),
    z AS MATERIALIZED (SELECT {_CV_GROUPS}, s, (x-m)/sd AS z, c FROM s JOIN st USING ({_CV_GROUPS})),
    p AS (SELECT {_CV_GROUPS}, a.s AS s1, b.s AS s2, avg(sqrt((a.z-b.z)^2 + CASE WHEN a.c=b.c THEN 0 ELSE 2 END)) AS d FROM z a JOIN z b USING ({_CV_GROUPS}) WHERE a.s <= b.s GROUP BY ALL),
    g AS (SELECT {_CV_GROUPS}, greatest(2*max(d) FILTER (WHERE s1=0 AND s2=1) - max(d) FILTER (WHERE s1=0 AND s2=0) - max(d) FILTER (WHERE s1=1 AND s2=1), 0) AS energy FROM p GROUP BY ALL),
    k AS (SELECT {_CV_GROUPS}, avg((xi-x_true)^2)/var_samp(x_true)/2 AS mse, avg((ci<>c_true)::INTEGER)/2 AS error FROM r GROUP BY ALL)
    SELECT trial::BIGINT AS trial, fold, {srnd('mse')} AS mse, {srnd('error')} AS error, {srnd('energy')} AS energy, {srnd('mse+error+energy')} AS loss FROM k JOIN g USING ({_CV_GROUPS})""")
def masked_cv_scores(spark, d):
    """Two fixed lines as trials, scored on every fold at once."""
    def line(a, b):
        return lambda s: s.withColumns({
            "x_true": F.when(F.col("_miss_x_true"), F.lit(a) + F.lit(b) * F.col("x_star")).otherwise(F.col("x_true")),
            "c_true": F.when(F.col("_miss_c_true"), F.col("c_star")).otherwise(F.col("c_true")),
        })

    roles = Roles("row_id", (("x_star", "x_true"), ("c_star", "c_true")), ("x_true", "x_star"), ("c_true", "c_star"))
    cols = fx.cohort(spark, d).select("row_id", "x_star", "x_true", "c_star", "c_true")
    out = tuning.masked_cv_scores(cols, roles, {t: line(*ab) for t, ab in _CV_LINES.items()}, 12, 1, 3)
    return out.select("trial", "fold", *[rnd(c).alias(c) for c in ("mse", "error", "energy", "loss")])


def _fold_sql(f: int) -> str:
    """One fold of the pruning rule: trials no earlier fold pruned, the current one in its history."""
    left = " ".join(f"AND NOT EXISTS (SELECT 1 FROM f{e} WHERE f{e}.trial = s.trial AND f{e}.pruned)" for e in range(f))
    hit = "count(*) OVER w >= 12 AND m1 > quantile_cont(m1, 0.75) OVER w AND m2 > quantile_cont(m2, 0.75) OVER w" if f < 2 else "false"
    return f"""f{f} AS MATERIALIZED (SELECT trial, fold, {hit} AS pruned FROM s WHERE fold = {f} {left}
      WINDOW w AS (PARTITION BY study ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("prune_trials", f"""WITH s AS MATERIALIZED (SELECT l_suppkey // 50 AS study, l_suppkey AS trial, l_linenumber % 3 AS fold,
      round(avg(l_discount)*100, 6) AS m1, round(avg(l_quantity), 6) AS m2 FROM lineitem GROUP BY ALL),
    {_fold_sql(0)}, {_fold_sql(1)}, {_fold_sql(2)}, f AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2)
    SELECT s.study, s.trial, s.fold, f.trial IS NOT NULL AS reached, coalesce(f.pruned, false) AS pruned FROM s LEFT JOIN f USING (trial, fold)""")
def prune_trials(spark, d):
    """Suppliers as trials, fifty to a study."""
    study = F.floor(F.col("l_suppkey") / 50).cast("bigint")
    s = table(spark, d, "lineitem").groupBy(study.alias("study"), F.col("l_suppkey").alias("trial"), (F.col("l_linenumber") % 3).alias("fold")).agg(
        F.round(F.avg("l_discount") * 100, 6).alias("m1"), F.round(F.avg("l_quantity"), 6).alias("m2"))
    return tuning.prune_trials(s, "trial", "fold", "m1", "m2", 50, ["study"]).select("study", "trial", "fold", "reached", "pruned")


@query("choose_config", f"""WITH {fx.TRIALS_SQL}, front AS (SELECT * FROM trials a WHERE NOT EXISTS (SELECT 1 FROM trials b
      WHERE b.avg_mse <= a.avg_mse AND b.avg_ed <= a.avg_ed AND (b.avg_mse < a.avg_mse OR b.avg_ed < a.avg_ed)))
    SELECT {srnd('quantile_cont(param_rate, 0.5)')} AS param_rate, round(quantile_cont(param_depth, 0.5))::INTEGER AS param_depth FROM front""")
def choose_config(spark, d):
    out = tuning.choose_config(fx.trials(spark, d), "avg_mse", "avg_ed", ["param_rate", "param_depth"], ["param_depth"])
    return out.withColumn("param_rate", rnd("param_rate"))


@query("coefficient_bias_score", f"""WITH {fx.ESTIMATES_SQL}, {fx.TRUTH_SQL}, sc AS (SELECT avg(abs(truth)) AS s FROM truth),
    j AS (SELECT rep, method, abs(estimate-truth)/(abs(truth)+s) AS v, CASE WHEN term='level' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM estimates JOIN truth USING (term), sc)
    SELECT rep, method, {srnd('sum(w*v)/sum(w)')} AS score FROM j GROUP BY ALL""")
def coefficient_bias_score(spark, d):
    out = tuning.coefficient_bias_score(fx.estimates(spark, d), fx.truth(spark, d), {"level": 2.0}, ["rep", "method"])
    return out.withColumn("score", rnd("score"))


@query("choose_rounds")
def choose_rounds(spark, d):
    f = fx.cohort(spark, d).select("row_id", "x_true", "x_star", "z_bal")
    best = tuning.choose_rounds(f, "x_true", ["x_star", "z_bal"], "row_id", 3, folds=2, repeats=1, rounds=6, maxDepth=2)
    return spark.createDataFrame([(best,)], "rounds int")


# ------------------------------------------------------------- end to end

RUBIN_SQL = f"""pooled AS (SELECT term, count(*)::DOUBLE AS m, avg(estimate) AS q, avg(se2) AS u, var_samp(estimate) AS b FROM each GROUP BY 1),
    rubin AS MATERIALIZED (SELECT term, q AS estimate, sqrt(u + (1+1/m)*b) AS se, (m-1)*(1+u/((1+1/m)*b))^2 AS df, (1+1/m)*b/u AS r FROM pooled),
    limits AS ({ds.t_quantile_sql('rubin', 'df')})"""

FLAGSHIP = f"""{ds.draw_norm_sql('pa', 's', 'x_true', NORM_XS, 2, 'once|x_true', 5)},
    done AS MATERIALIZED (SELECT imp_id, y, z_bal, CASE WHEN r = 1 THEN x_true ELSE {ds.drawn(NORM_XS, 2, 'once|x_true')} END AS x FROM s, pap),
    {ds.lm_sql('po', 'done', 'y', ['1', 'x', 'z_bal'], 'imp_id')}, {ds.root_sql('po', 'pof', 3, 'imp_id')},
    each AS (SELECT imp_id, unnest(['(Intercept)', 'x_true', 'z_bal']) AS term, unnest([b0, b1, b2]) AS estimate,
      unnest([l0_0*l0_0, l1_0*l1_0 + l1_1*l1_1, l2_0*l2_0 + l2_1*l2_1 + l2_2*l2_2])*rss/(n-3) AS se2 FROM pof JOIN pol USING (imp_id)),
    {RUBIN_SQL}"""


@query("flagship_pooled_lm", f"""WITH {S_SQL}, {FLAGSHIP} SELECT term, {srnd('estimate')} AS estimate, {srnd('se')} AS se, {srnd('estimate - t975*se')} AS lower,
    {srnd('estimate + t975*se')} AS upper, {srnd('(r + 2/(df+3))/(r+1)')} AS fmi FROM limits""")
def flagship_pooled_lm(spark, d):
    """Sample 5%, impute the exposure five times, fit y per imputation, pool."""
    s = sampled(spark, d)
    imp = chained.impute_fixed(s, {"x_true": Target("norm", {"x_star": F.col("x_star"), "z_bal": F.col("z_bal"), "y": F.col("y")})}, "row_id", 5, 2)
    est = linear.coef_table(linear.fit_lm(imp, "y", ["x_true", "z_bal"], by=["imp_id"]))
    out = ev.pool_rubin(est, ["term"])
    return out.select("term", *[rnd(c).alias(c) for c in ("estimate", "se", "lower", "upper", "fmi")])


_COX_XS = ["1", "x_star", "ln(1+time)", "event"]
POOLED_COX = f"""{ds.draw_norm_sql('pa', 's', 'x_true', _COX_XS, 2, 'once|x_true', 3)},
    done AS MATERIALIZED (SELECT imp_id, time, event, z_bal, CASE WHEN r = 1 THEN x_true ELSE {ds.drawn(_COX_XS, 2, 'once|x_true')} END AS x FROM s, pap),
    {', '.join(f"i{i} AS MATERIALIZED (SELECT * FROM done WHERE imp_id = {i}), {cox2('time', 'event', 'x', 'z_bal', f'i{i}', tag=f'c{i}_')}" for i in (1, 2, 3))},
    each AS ({' UNION ALL '.join(f"SELECT unnest(['x_true', 'z_bal']) AS term, unnest([b1, b2]) AS estimate, unnest([v11, v22]) AS se2 FROM c{i}_7" for i in (1, 2, 3))}),
    {RUBIN_SQL}"""


@query("pooled_cox", f"""WITH {S_SQL}, {POOLED_COX} SELECT term, {srnd('estimate')} AS estimate, {srnd('se')} AS se, {srnd('estimate - t975*se')} AS lower,
    {srnd('estimate + t975*se')} AS upper, {srnd('(r + 2/(df+3))/(r+1)')} AS fmi FROM limits""")
def pooled_cox(spark, d):
    """The same flow with a survival outcome."""
    s = cut(sampled(spark, d).select("row_id", "x_true", "x_star", "z_bal", "time", "event"))  # joined and drawn once
    imp = chained.impute_fixed(s, {"x_true": Target("norm", {"x_star": F.col("x_star"), "time": F.log1p("time"), "event": F.col("event").cast("double")})}, "row_id", 3, 2)
    imp = cut(imp.select("imp_id", "x_true", "z_bal", "time", "event"))  # sampled for its ranges, then dealt
    fit = cox.fit_cox(imp, "time", "event", ["x_true", "z_bal"], by=["imp_id"])
    out = ev.pool_rubin(linear.coef_table(fit), ["term"])
    return out.select("term", *[rnd(c).alias(c) for c in ("estimate", "se", "lower", "upper", "fmi")])


@query("complete_case_lm", f"WITH {S_SQL}, p AS (SELECT * FROM s WHERE r=1), {newton3('y', 'x_true', 'z_bal', 'gaussian', 'p', steps=2)} {long_terms([('(Intercept)', 'b0', '0'), ('x_true', 'b1', '0'), ('z_bal', 'b2', '0')], 'g2')}")
def complete_case_lm(spark, d):
    """Validated rows only."""
    t = linear.coef_table(linear.fit_lm(sampled(spark, d), "y", ["x_true", "z_bal"]))
    return t.select("term", rnd("estimate").alias("estimate"), F.lit(0.0).alias("se"))

