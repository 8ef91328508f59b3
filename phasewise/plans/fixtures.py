"""Two-phase cohorts derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions.keyed import uniform_of
from phasewise.operators.columns import Roles
from phasewise.plans.registry import table

COHORT_ROLES = Roles(
    key="row_id",
    pairs=(("x_star", "x_true"), ("c_star", "c_true")),
    numeric=("x_true", "x_star", "z_bal", "y", "time"),
    categorical=("c_true", "c_star", "z_seg", "yb", "event"),
)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table in one small file is read by one task; deal it out. Larger tables have splits enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < min(cores, 8) else df


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: true and error-prone columns, outcomes and survival times."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    o = spread(o, "o_orderkey")
    k = F.col("o_orderkey")
    x = F.log("o_totalprice")
    base = o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        k.alias("row_id"),
        F.col("c_mktsegment").alias("z_seg"),
        (F.col("c_acctbal") / 1000).alias("z_bal"),
        x.alias("x_true"),
        (F.lit(0.8) * x + F.lit(1.2) * (uniform_of("xs", k) - 0.5) + 2.0).alias("x_star"),
        F.col("o_orderpriority").alias("c_true"),
        F.when(uniform_of("cs", k) < 0.8, F.col("o_orderpriority")).otherwise("3-MEDIUM").alias("c_star"),
    )
    xt, key = F.col("x_true"), F.col("row_id")
    return base.select(
        "*",
        (F.lit(1.0) + F.lit(0.5) * xt + F.lit(0.1) * F.col("z_bal") + F.lit(2.0) * (uniform_of("y", key) - 0.5)).alias("y"),
        F.when(uniform_of("yb", key) < 1 / (1 + F.exp(-(xt - 12))), 1).otherwise(0).alias("yb"),
        (-F.log(1 - uniform_of("t", key)) * F.exp(F.lit(-0.3) * (xt - 12))).alias("time"),
        F.when(uniform_of("e", key) < 0.7, 1).otherwise(0).alias("event"),
    )


def su(tag: str, key: str) -> str:
    """SQL for the fixture uniform."""
    return f"(('0x'||substr(md5('{tag}|'||{key}::VARCHAR),1,13))::BIGINT::DOUBLE/4503599627370496)"


def skey(seed, tag: str, *keys: str) -> str:
    """SQL for the keyed uniform over (seed, tag, key...)."""
    text = "||'|'||".join([f"'{seed}|{tag}'"] + [f"{k}::VARCHAR" for k in keys])
    return f"(('0x'||substr(md5({text}),1,13))::BIGINT::DOUBLE/4503599627370496)"


def snormal(seed, tag: str, *keys: str) -> str:
    a, b = skey(seed, f"{tag}a", *keys), skey(seed, f"{tag}b", *keys)
    return f"(sqrt(-2.0::DOUBLE*ln(1.0::DOUBLE-{a}))*cos(2*pi()*{b}))"


COHORT_SQL = f"""
base AS (
  SELECT o_orderkey AS row_id, c_mktsegment AS z_seg, c_acctbal/1000 AS z_bal, ln(o_totalprice) AS x_true,
         0.8::DOUBLE*ln(o_totalprice) + 1.2::DOUBLE*({su('xs', 'o_orderkey')} - 0.5::DOUBLE) + 2.0::DOUBLE AS x_star,
         o_orderpriority AS c_true,
         CASE WHEN {su('cs', 'o_orderkey')} < 0.8::DOUBLE THEN o_orderpriority ELSE '3-MEDIUM' END AS c_star
  FROM orders JOIN customer ON o_custkey = c_custkey),
cohort AS MATERIALIZED (
  SELECT *, 1.0::DOUBLE + 0.5::DOUBLE*x_true + 0.1::DOUBLE*z_bal + 2.0::DOUBLE*({su('y', 'row_id')} - 0.5::DOUBLE) AS y,
         CASE WHEN {su('yb', 'row_id')} < 1/(1+exp(-(x_true-12))) THEN 1 ELSE 0 END AS yb,
         -ln(1-{su('t', 'row_id')})*exp(-0.3::DOUBLE*(x_true-12)) AS time,
         CASE WHEN {su('e', 'row_id')} < 0.7::DOUBLE THEN 1 ELSE 0 END AS event
  FROM base)"""


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates per (rep, design, method, term): group means of the cohort, 20 replicates."""
    d = cohort(spark, sf_dir).withColumn("rep", (F.col("row_id") % 20).cast("int"))
    parts = []
    for method, col in (("full", "x_true"), ("star", "x_star")):
        parts += [
            F.struct(F.lit(method).alias("method"), F.lit("level").alias("term"), F.col(col).alias("v")),
            F.struct(F.lit(method).alias("method"), F.lit("outcome").alias("term"), (F.col(col) * F.col("y")).alias("v")),
        ]
    long = d.select("rep", F.col("z_seg").alias("design"), F.explode(F.array(*parts)).alias("e")).select("rep", "design", "e.*")
    g = long.groupBy("rep", "design", "method", "term").agg(
        F.avg("v").alias("estimate"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("se")
    )
    return g.withColumns({
        "lower": F.col("estimate") - F.lit(1.96) * F.col("se"),
        "upper": F.col("estimate") + F.lit(1.96) * F.col("se"),
    })


ESTIMATES_SQL = COHORT_SQL + """,
longe AS (
  SELECT row_id % 20 AS rep, z_seg AS design, 'full' AS method, 'level' AS term, x_true AS v FROM cohort
  UNION ALL SELECT row_id % 20, z_seg, 'full', 'outcome', x_true*y FROM cohort
  UNION ALL SELECT row_id % 20, z_seg, 'star', 'level', x_star FROM cohort
  UNION ALL SELECT row_id % 20, z_seg, 'star', 'outcome', x_star*y FROM cohort),
est0 AS (SELECT rep::INTEGER AS rep, design, method, term, avg(v) AS estimate, stddev_samp(v)/sqrt(count(*)) AS se
         FROM longe GROUP BY ALL),
estimates AS MATERIALIZED (SELECT *, estimate-1.96::DOUBLE*se AS lower, estimate+1.96::DOUBLE*se AS upper FROM est0)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-cohort value of each term."""
    d = cohort(spark, sf_dir).agg(F.avg("x_true").alias("a"), F.avg(F.col("x_true") * F.col("y")).alias("b"))
    return d.select(F.explode(F.array(
        F.struct(F.lit("level").alias("term"), F.col("a").alias("truth")),
        F.struct(F.lit("outcome").alias("term"), F.col("b").alias("truth")),
    )).alias("e")).select("e.*")


TRUTH_SQL = """
truth AS (SELECT 'level' AS term, avg(x_true) AS truth FROM cohort
          UNION ALL SELECT 'outcome', avg(x_true*y) FROM cohort)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search trial per part: two losses and two parameters, aggregated from line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("trial_number")).agg(
        F.avg("l_discount").alias("avg_mse"),
        F.avg("l_quantity").alias("avg_ed"),
        F.avg("l_tax").alias("param_rate"),
        F.max("l_linenumber").alias("param_depth"),
    ).withColumns({"avg_mse": F.round(F.col("avg_mse") * 100, 3), "avg_ed": F.round("avg_ed", 3)})


TRIALS_SQL = """
trials AS MATERIALIZED (
  SELECT l_partkey AS trial_number, round(avg(l_discount)*100, 3) AS avg_mse, round(avg(l_quantity), 3) AS avg_ed,
         avg(l_tax) AS param_rate, max(l_linenumber) AS param_depth
  FROM lineitem GROUP BY 1)"""


def subjects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Longitudinal stand-in: index events (first purchase per user) and facts (views, in days)."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 86_400_000_000).alias("day")
    )
    return e, e.where(F.col("event_type") == "view")


SUBJECTS_SQL = """
ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts)/86400000000 AS day FROM events)"""
