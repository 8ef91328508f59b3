"""Queries for sampling designs, allocation and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasewise.operators import allocation, designs, resampling
from phasewise.operators.columns import cross_strata, cut_bins, quantile_bins
from phasewise.plans import fixtures as fx
from phasewise.plans.registry import query, rnd, srnd, table
from phasewise.models import linear

C = fx.COHORT_SQL
SHARE = 0.05  # validated share of the cohort


def cohort(spark, d):
    f = fx.cohort(spark, d)
    return f, int(f.count() * SHARE)


N = "(SELECT floor(count(*)*0.05)::BIGINT FROM cohort)"


def lm2(y: str, a: str, b: str, src: str = "cohort", tag: str = "m") -> str:
    """SQL common tables for y ~ 1 + a + b: <tag>s (moments) and <tag> (coefficients)."""
    return f"""
{tag}s AS (SELECT count(*)::DOUBLE AS n, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my,
   regr_sxx({a},{a}) AS saa, regr_sxx({b},{b}) AS sbb, regr_sxy({b},{a}) AS sab, regr_sxy({y},{a}) AS say, regr_sxy({y},{b}) AS sby,
   regr_sxx({y},{y}) AS syy FROM {src}),
{tag} AS MATERIALIZED (SELECT *, (saa*sbb-sab*sab) AS det, (sbb*say-sab*sby)/(saa*sbb-sab*sab) AS ba, (saa*sby-sab*say)/(saa*sbb-sab*sab) AS bb FROM {tag}s)"""


def resid2(y, a, b, tag="m"):
    return f"({y} - {tag}.my - {tag}.ba*({a}-{tag}.ma) - {tag}.bb*({b}-{tag}.mb))"


def influence2(y, a, b, tag="m"):
    """Leave-one-out change of the coefficient of ``a``."""
    da, db = f"({a}-{tag}.ma)", f"({b}-{tag}.mb)"
    ra = f"(({tag}.sbb*{da}-{tag}.sab*{db})/{tag}.det)"
    rb = f"(({tag}.saa*{db}-{tag}.sab*{da})/{tag}.det)"
    h = f"(1/{tag}.n + {da}*{ra} + {db}*{rb})"
    return f"({ra}*{resid2(y, a, b, tag)}/(1-{h}))"


def tails(score: str, extra: str = "") -> str:
    return f"""t AS (SELECT *, row_number() OVER (ORDER BY {score}, row_id) AS p, count(*) OVER () AS total FROM s)
    SELECT row_id{extra}, CASE WHEN p <= {N}//2 OR p > total - {N}//2 THEN 1 ELSE 0 END AS "R" FROM t"""


@query("srs", f"""WITH {C}, k AS (SELECT row_id, x_true, row_number() OVER (ORDER BY {fx.skey(1, 'srs', 'row_id')}, row_id) <= {N} AS hit FROM cohort)
    SELECT row_id, hit::INTEGER AS "R", 1.0::DOUBLE AS "W", CASE WHEN hit THEN {srnd('x_true')} END AS x_true FROM k""")
def srs(spark, d):
    f, n = cohort(spark, d)
    return designs.srs(f.select("row_id", rnd("x_true").alias("x_true")), "row_id", n, 1, ["x_true"]).select("row_id", "R", "W", "x_true")


@query("srs_replicates", f"""WITH {C}, r AS (SELECT row_id, row_id % 5 AS rep FROM cohort)
    SELECT rep, row_id FROM r QUALIFY row_number() OVER (PARTITION BY rep ORDER BY {fx.skey(1, 'srs', 'rep', 'row_id')}, row_id) <= 40""")
def srs_replicates(spark, d):
    f = fx.cohort(spark, d).select("row_id", (F.col("row_id") % 5).alias("rep"))
    return designs.srs(f, "row_id", 40, 1, by=["rep"]).where("R = 1").select("rep", "row_id")


@query("ods_tail", f"WITH {C}, s AS (SELECT row_id, y FROM cohort), {tails('y')}")
def ods_tail(spark, d):
    f, n = cohort(spark, d)
    return designs.ods_tail(f.select("row_id", "y"), "y", "row_id", n).select("row_id", "R")


@query("residual_sampling", f"""WITH {C}, {lm2('y', 'z_bal', 'x_star')}, s AS (SELECT row_id, {resid2('y', 'z_bal', 'x_star')} AS rs FROM cohort, m),
    {tails('rs', ', ' + srnd('rs') + ' AS rs')}""")
def residual_sampling(spark, d):
    f, n = cohort(spark, d)
    return designs.residual_sampling(f, "y", ["z_bal", "x_star"], "row_id", n).select("row_id", rnd("rs").alias("rs"), "R")


@query("score_sampling", f"""WITH {C}, m AS (SELECT regr_slope(y, z_bal) AS b, regr_intercept(y, z_bal) AS a FROM cohort),
    s AS (SELECT row_id, (y - a - b*z_bal)*x_star AS score FROM cohort, m), {tails('score', ', ' + srnd('score') + ' AS score')}""")
def score_sampling(spark, d):
    f, n = cohort(spark, d)
    return designs.score_sampling(f, "y", ["z_bal"], "x_star", "row_id", n).select("row_id", rnd("score").alias("score"), "R")


@query("weighted_residual_sampling", f"""WITH {C}, pn AS (SELECT {N} AS n, round_even({N}*0.1::DOUBLE, 0)::BIGINT AS np),
    pk AS (SELECT *, row_number() OVER (ORDER BY {fx.skey(3, 'srs', 'row_id')}, row_id) <= (SELECT np FROM pn) AS pilot FROM cohort),
    {lm2('x_true', 'x_star', 'z_bal', '(SELECT * FROM pk WHERE pilot)', 'pm')},
    b AS (SELECT regr_slope(y, z_bal) AS b, regr_intercept(y, z_bal) AS a FROM pk WHERE NOT pilot),
    sdp AS (SELECT stddev_samp({resid2('x_true', 'x_star', 'z_bal', 'pm')}) AS sd FROM pk, pm WHERE pilot),
    s AS (SELECT row_id, pilot, CASE WHEN pilot THEN {resid2('x_true', 'x_star', 'z_bal', 'pm')} ELSE (y - b.a - b.b*z_bal)*sd END AS wrs FROM pk, pm, b, sdp),
    t AS (SELECT *, row_number() OVER (PARTITION BY pilot ORDER BY wrs, row_id) AS p, count(*) OVER (PARTITION BY pilot) AS total FROM s)
    SELECT row_id, {srnd('wrs')} AS wrs, CASE WHEN pilot OR p <= (n-np)//2 OR p > total - (n-np)//2 THEN 1 ELSE 0 END AS "R" FROM t, pn""")
def weighted_residual_sampling(spark, d):
    f, n = cohort(spark, d)
    out = designs.weighted_residual_sampling(f, "y", ["z_bal"], "x_true", ["x_star", "z_bal"], "row_id", n, 3)
    return out.select("row_id", rnd("wrs").alias("wrs"), "R")


def strata_sql(column: str) -> str:
    return f"""(CASE WHEN {column} <= (SELECT quantile_cont({column}, 0.19) FROM cohort) THEN 1
        WHEN {column} <= (SELECT quantile_cont({column}, 0.81) FROM cohort) THEN 2 ELSE 3 END)"""


def alloc_sql(target: str, stratum: str, src: str, cap: bool = False, n: str = N) -> str:
    """Common tables h (strata) and al (allocation) by listing every priority value."""
    room = "size - 1" if cap else f"{n}"
    return f"""h AS MATERIALIZED (SELECT {stratum} AS st, count(*) AS size, coalesce(stddev_samp({target}), 0) AS sd FROM {src} GROUP BY 1),
    pr AS (SELECT st, size*sd AS ns, unnest(range(2, {room} + 1)) AS j FROM h),
    top AS (SELECT st FROM pr ORDER BY ns/sqrt(j*(j+1.0::DOUBLE)) DESC, ns DESC, st LIMIT (SELECT greatest({n} - 2*count(*), 0) FROM h)),
    al AS MATERIALIZED (SELECT h.st, size, sd, least(2 + coalesce(c, 0), {'size' if cap else '9223372036854775807'})::BIGINT AS alloc
        FROM h LEFT JOIN (SELECT st, count(*) AS c FROM top GROUP BY 1) USING (st))"""


def draw_sql(stratum: str, src: str, seed, extra: str = "") -> str:
    return f"""SELECT row_id, {stratum} AS strata{extra}, CASE WHEN row_number() OVER (PARTITION BY {stratum} ORDER BY {fx.skey(seed, 'draw', stratum, 'row_id')}, row_id) <= alloc THEN 1 ELSE 0 END AS "R",
      {srnd('size/least(alloc, size)')} AS "W" FROM {src} JOIN al ON al.st = {stratum}"""


def neyman_query(name, strata_col, target_sql, seed, build):
    sql = f"""WITH {C}, {lm2('y', 'x_star', 'z_bal')}, s AS MATERIALIZED (SELECT row_id, y, x_star, {strata_sql(strata_col)} AS outcome_strata,
      {target_sql} AS target FROM cohort, m), {alloc_sql('target', 'outcome_strata', 's')} {draw_sql('outcome_strata', 's', seed)}"""

    @query(name, sql)
    def run(spark, d):
        f, n = cohort(spark, d)
        return build(f, n).select("row_id", F.col("outcome_strata").alias("strata"), "R", rnd("W").alias("W"))

    return run


TERMS = ["x_star", "z_bal"]
neyman_query("neyman_ods", "y", "x_star", 21, lambda f, n: designs.neyman_ods(f, "y", "x_star", "row_id", n, 21))
neyman_query("neyman_inf", "y", influence2("y", "x_star", "z_bal"), 22,
             lambda f, n: designs.neyman_inf(f, "y", TERMS, "x_star", "row_id", n, 22))
neyman_query("neyman_ods_unval", "x_star", "y", 23, lambda f, n: designs.neyman_ods_unval(f, "y", "x_star", "row_id", n, 23))
neyman_query("neyman_inf_unval", "x_star", influence2("y", "x_star", "z_bal"), 24,
             lambda f, n: designs.neyman_inf_unval(f, "y", TERMS, "x_star", "x_star", "row_id", n, 24))

CROSSED = "(event::VARCHAR||'.'||(CASE WHEN time<=0.5 THEN 1 WHEN time<=1 THEN 2 WHEN time<=2 THEN 3 ELSE 4 END)::VARCHAR||'.'||(CASE WHEN x_star<=11.5 THEN 1 WHEN x_star<=12 THEN 2 ELSE 3 END)::VARCHAR||'.'||z_seg)"


def crossed(spark, d):
    f, n = cohort(spark, d)
    label = cross_strata("event", cut_bins("time", [0.5, 1, 2]), cut_bins("x_star", [11.5, 12]), "z_seg")
    return f.withColumn("STRATA", label), n


@query("balanced", f"""WITH {C}, s AS MATERIALIZED (SELECT row_id, {CROSSED} AS st0 FROM cohort), h AS (SELECT st0 AS st, count(*) AS size FROM s GROUP BY 1),
    q AS (SELECT *, least(size, {N}//(count(*) OVER ())) AS a0 FROM h),
    q1 AS (SELECT *, {N} - sum(a0) OVER () AS remain, count(*) FILTER (WHERE size > a0) OVER () AS k FROM q),
    q2 AS (SELECT *, CASE WHEN size > a0 THEN least(ceil(remain/k), size - a0) ELSE 0 END AS give FROM q1),
    al AS MATERIALIZED (SELECT st, size, (a0 + least(give, greatest(remain - coalesce(sum(give) OVER (ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)))::BIGINT AS alloc FROM q2)
    {draw_sql('st0', 's', 31)}""")
def balanced(spark, d):
    f, n = crossed(spark, d)
    return designs.balanced(f, "STRATA", "row_id", n, 31).select("row_id", F.col("STRATA").alias("strata"), "R", rnd("W").alias("W"))


@query("exact_allocation", f"""WITH {C}, s AS (SELECT row_id, y, {CROSSED} AS st0 FROM cohort), {alloc_sql('y', 'st0', 's')}
    SELECT st AS strata, size, {srnd('sd')} AS sd, alloc FROM al""")
def exact_allocation(spark, d):
    f, n = crossed(spark, d)
    out = allocation.exact_allocation(f, "STRATA", "y", n)
    return out.select(F.col("STRATA").alias("strata"), "size", rnd("sd").alias("sd"), "alloc")


@query("exact_allocation_capped", f"""WITH {C}, s AS (SELECT row_id, y, {CROSSED} AS st0 FROM cohort), {alloc_sql('y', 'st0', 's', True, '(SELECT floor(count(*)*0.5)::BIGINT FROM cohort)')}
    SELECT st AS strata, size, {srnd('sd')} AS sd, alloc FROM al""")
def exact_allocation_capped(spark, d):
    f, _ = crossed(spark, d)
    out = allocation.exact_allocation(f, "STRATA", "y", int(f.count() * 0.5), cap=True)
    return out.select(F.col("STRATA").alias("strata"), "size", rnd("sd").alias("sd"), "alloc")


@query("draw_per_stratum", f"""WITH {C}, h AS (SELECT z_seg AS st, count(*) AS size FROM cohort GROUP BY 1), al AS (SELECT *, floor(size/10)::BIGINT AS alloc FROM h)
    {draw_sql('z_seg', 'cohort', 41)}""")
def draw_per_stratum(spark, d):
    f = fx.cohort(spark, d).select("row_id", "z_seg")
    quota = f.groupBy("z_seg").agg(F.count("*").alias("size")).withColumn("alloc", F.floor(F.col("size") / 10))
    return designs.draw_per_stratum(f, "z_seg", quota, "row_id", 41).select("row_id", F.col("z_seg").alias("strata"), "R", rnd("W").alias("W"))


@query("design_weights", f"""WITH {C} SELECT z_seg, count(*) AS size, sum(yb)::BIGINT AS chosen, {srnd('count(*)/sum(yb)')} AS weight, {srnd('sum(yb)/count(*)')} AS share FROM cohort GROUP BY 1""")
def design_weights(spark, d):
    out = allocation.design_weights(fx.cohort(spark, d).withColumn("R", F.col("yb")), "z_seg")
    return out.withColumns({"weight": rnd("weight"), "share": rnd("share")})


LONE = "(yb::VARCHAR||'.'||least(floor(time*4),60)::INTEGER::VARCHAR||'.'||floor(x_true*3)::INTEGER::VARCHAR)"


def lone(spark, d):
    label = cross_strata("yb", F.least(F.floor(F.col("time") * 4), F.lit(60)), F.floor(F.col("x_true") * 3))
    return fx.cohort(spark, d).withColumn("STRATA", label)


@query("merge_lone_strata", f"""WITH {C}, s AS MATERIALIZED (SELECT row_id, {LONE} AS st FROM cohort),
    h AS (SELECT st, count(*) AS n, split_part(st,'.',1) AS f, split_part(st,'.',2)::INTEGER AS a, split_part(st,'.',3)::INTEGER AS b FROM s GROUP BY 1),
    mv AS (SELECT l.st, m.st AS target, m.n, row_number() OVER (PARTITION BY l.st ORDER BY abs(l.a-m.a)+abs(l.b-m.b), m.st) AS rn FROM h l JOIN h m ON l.f=m.f AND l.n=1 AND m.n>1)
    SELECT row_id, coalesce(mv.target, s.st) AS "STRATA", coalesce(mv.n, h.n) AS fpc FROM s JOIN h USING (st) LEFT JOIN mv ON mv.st = s.st AND rn = 1""")
def merge_lone_strata(spark, d):
    return allocation.merge_lone_strata(lone(spark, d), "STRATA").select("row_id", "STRATA", "fpc")


@query("merge_empty_strata", f"""WITH {C}, s AS MATERIALIZED (SELECT row_id, floor(x_true*10)::BIGINT AS st, CASE WHEN yb=1 AND floor(x_true*10)::BIGINT % 3 <> 0 THEN 1 ELSE 0 END AS r FROM cohort),
    h AS (SELECT st, sum(r) AS r FROM s GROUP BY 1),
    m AS (SELECT st, coalesce(last_value(CASE WHEN r>0 THEN st END IGNORE NULLS) OVER (ORDER BY st), first_value(CASE WHEN r>0 THEN st END IGNORE NULLS) OVER (ORDER BY st ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), st) AS target FROM h)
    SELECT row_id, target AS strata FROM s JOIN m USING (st)""")
def merge_empty_strata(spark, d):
    f = fx.cohort(spark, d).withColumn("strata", F.floor(F.col("x_true") * 10))
    f = f.withColumn("R", F.when((F.col("yb") == 1) & (F.col("strata") % 3 != 0), 1).otherwise(0))
    return allocation.merge_empty_strata(f, "strata").select("row_id", "strata")


@query("bootstrap", f"""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY {fx.skey(51, 'row', 'o_orderkey')}, o_orderkey) AS i, count(*) OVER () AS n FROM orders),
    dr AS (SELECT b AS imp_id, floor(('0x'||substr(md5('51|boot|'||b::VARCHAR||'|'||id::VARCHAR),1,13))::BIGINT::DOUBLE/4503599627370496*n)::BIGINT+1 AS i
      FROM (SELECT count(*) AS n, unnest(range(1, count(*)+1)) AS id FROM orders), (SELECT unnest([1,2,3]) AS b))
    SELECT imp_id, o_orderkey, count(*) AS multiplicity FROM dr JOIN o USING (i) GROUP BY ALL""")
def bootstrap(spark, d):
    return resampling.bootstrap(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3, 51)


@query("weighted_resample", f"""WITH o AS MATERIALIZED (SELECT c_custkey, greatest(c_acctbal, 0) AS w, sum(greatest(c_acctbal, 0)) OVER (ORDER BY c_custkey) AS c FROM customer),
    dr AS (SELECT {fx.skey(61, 'weighted', 'id')}*(SELECT max(c) FROM o) AS pos FROM (SELECT unnest(range(1, count(*)+1)) AS id FROM customer))
    SELECT c_custkey, count(*) AS multiplicity FROM dr ASOF JOIN (SELECT * , c - w AS lo FROM o WHERE w > 0) s ON dr.pos >= s.lo GROUP BY 1""")
def weighted_resample(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("w"))
    return resampling.weighted_resample(c, "c_custkey", "w", c.count(), 61).select("c_custkey", "multiplicity")


@query("even_by_category", f"""WITH h AS (SELECT c_nationkey, count(*) AS size, row_number() OVER (ORDER BY c_nationkey) AS p, count(*) OVER () AS k FROM customer GROUP BY 1),
    q AS (SELECT *, 1501//k + CASE WHEN p <= 1501 % k THEN 1 ELSE 0 END AS want FROM h),
    r AS (SELECT c_custkey, c.c_nationkey, size, want, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY {fx.skey(71, 'even', 'c.c_nationkey', 'c_custkey')}, c_custkey) AS i FROM customer c JOIN q USING (c_nationkey)),
    dr AS (SELECT c_nationkey, floor(('0x'||substr(md5('71|again|'||c_nationkey::VARCHAR||'|'||t::VARCHAR),1,13))::BIGINT::DOUBLE/4503599627370496*size)::BIGINT+1 AS i FROM (SELECT c_nationkey, size, unnest(range(1, want+1)) AS t FROM q WHERE size < want))
    SELECT c_custkey, c_nationkey, 1::BIGINT AS multiplicity FROM r WHERE size >= want AND i <= want
    UNION ALL SELECT c_custkey, c_nationkey, count(*) FROM dr JOIN r USING (c_nationkey, i) GROUP BY 1, 2""")
def even_by_category(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return resampling.even_by_category(c, "c_nationkey", "c_custkey", 1501, 71).select("c_custkey", "c_nationkey", "multiplicity")
