"""Queries for sources, typing, joins, aggregates, windows and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasewise.functions import scalar
from phasewise.functions.keyed import uniform
from phasewise.operators import aggregates, columns, joins, order
from phasewise.plans import fixtures as fx
from phasewise.plans.registry import query, rnd, srnd, table
from phasewise.session import ensure_checkpoint_dir
from phasewise.sources import tables as src

C = fx.COHORT_SQL
YEAR = 365.25


def scratch(spark, name):
    """Fresh folder next to the checkpoints (shared by all executors)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks

@query("read_cohort", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def read_cohort(spark, d):
    path = scratch(spark, "cohort-csv")
    c = table(spark, d, "customer")
    c.select(
        F.col("c_custkey").alias("Unnamed: 0"), F.col("c_custkey").alias(" c_custkey"),
        F.col("c_acctbal").alias("c_acctbal "), "c_mktsegment",
    ).write.option("header", True).csv(path)
    return src.read_cohort(spark, path, "c_custkey bigint, c_acctbal double, c_mktsegment string")


@query("write_stacked", f"""WITH {C} SELECT row_id, {srnd('x_true + imp_id')} AS x, imp_id
    FROM cohort, (SELECT unnest([1,2,3]) AS imp_id)""")
def write_stacked(spark, d):
    path = scratch(spark, "stacked")
    df = fx.cohort(spark, d).select("row_id", "x_true", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("imp_id"))
    src.write_stacked(df.select("row_id", rnd(F.col("x_true") + F.col("imp_id")).alias("x"), "imp_id"), path)
    return src.read_stacked(spark, path)


@query("write_samples", f"""WITH {C} SELECT 'orders' AS type, z_seg AS design, (row_id % 5)::INTEGER AS rep,
    count(*) AS n, {srnd('sum(x_true)')} AS total FROM cohort GROUP BY ALL""")
def write_samples(spark, d):
    path = scratch(spark, "samples")
    df = fx.cohort(spark, d).select(
        F.lit("orders").alias("type"), F.col("z_seg").alias("design"), (F.col("row_id") % 5).cast("int").alias("rep"), "row_id", "x_true"
    )
    src.write_samples(df, path)
    return src.read_samples(spark, path).groupBy("type", "design", "rep").agg(
        F.count("*").alias("n"), rnd(F.sum("x_true")).alias("total")
    )


@query("pending_work", """SELECT c_custkey AS rep FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def pending_work(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("rep"))
    return src.pending_work(table(spark, d, "customer").select(F.col("c_custkey").alias("rep")), done, ["rep"])


@query("run_log", f"WITH {C} SELECT z_seg, count(*) AS rows, 2.5::DOUBLE AS seconds FROM cohort GROUP BY ALL")
def run_log(spark, d):
    path = scratch(spark, "log")
    log = src.run_log(fx.cohort(spark, d), 10.0, 12.5, ["z_seg"])
    src.append_run_log(log, path)
    return spark.read.parquet(path)


@query("estimates_table", f"""WITH {fx.ESTIMATES_SQL} SELECT rep, design, method, term, {srnd('estimate')} AS estimate,
    {srnd('se')} AS se, {srnd('lower')} AS lower, {srnd('upper')} AS upper FROM estimates""")
def estimates_table(spark, d):
    est = fx.estimates(spark, d)
    path = scratch(spark, "estimates")
    src.write_estimates(src.estimates_table(est.where("method = 'full'"), est.where("method = 'star'")), path)
    return spark.read.parquet(path).select(
        "rep", "design", "method", "term", *[rnd(c).alias(c) for c in ("estimate", "se", "lower", "upper")]
    )


@query("stack_rows", f"""WITH {C} SELECT row_id, {srnd('x_true')} AS x, NULL::VARCHAR AS c FROM cohort
    UNION ALL SELECT row_id, NULL, c_true FROM cohort""")
def stack_rows(spark, d):
    f = fx.cohort(spark, d)
    return src.stack(f.select("row_id", rnd("x_true").alias("x")), f.select("row_id", F.col("c_true").alias("c")))


# ---------------------------------------------------------------- typing and row-local work

@query("cast_to_template", """SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS l_quantity,
    CASE WHEN l_returnflag IN ('A','N') THEN l_returnflag END AS l_returnflag,
    CASE WHEN l_linestatus = 'F' THEN false ELSE l_linenumber % 2 = 1 END AS flag FROM lineitem""")
def cast_to_template(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("l_quantity"), "l_returnflag",
        F.when(F.col("l_linestatus") == "F", "FALSE").otherwise((F.col("l_linenumber") % 2).cast("string")).alias("flag"),
    )
    template = T.StructType.fromDDL("l_quantity int, flag boolean")
    return columns.cast_to_template(df, template, {"l_returnflag": ["A", "N"]})


@query("safe_numeric", """SELECT o_orderkey, o_totalprice AS price,
    dense_rank() OVER (ORDER BY o_orderpriority)::DOUBLE AS priority FROM orders""")
def safe_numeric(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("priority")
    )
    return columns.safe_numeric(df, ["price", "priority"])


@query("normalize_category", """SELECT p_partkey, p_size::VARCHAR AS size, p_type AS type FROM part""")
def normalize_category(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey",
        columns.normalize_category(F.concat(F.lit(" "), F.col("p_size").cast("double").cast("string"))).alias("size"),
        columns.normalize_category(F.concat(F.col("p_type"), F.lit("  "))).alias("type"),
    )


@query("robust_category", """SELECT p_partkey, p_size::VARCHAR AS plain, (-p_size)::VARCHAR AS negative, p_size::VARCHAR AS padded, (p_size*1000)::VARCHAR AS power,
    p_size::VARCHAR || '.5' AS half, p_type AS type FROM part""")
def robust_category(spark, d):
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", *[columns.robust_category(v).alias(n) for n, v in (
        ("plain", F.concat(F.lit(" "), size, F.lit(".0"))), ("negative", F.concat(F.lit("-"), size, F.lit(".00"))), ("padded", F.concat(F.lit("00"), size)),
        ("power", F.concat(size, F.lit("e3"))), ("half", F.concat(size, F.lit(".5"))), ("type", F.concat(F.col("p_type"), F.lit("  "))))])


@query("null_tokens", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders""")
def null_tokens(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "NaN").otherwise(F.col("o_orderstatus")).alias("status")
    )
    return columns.null_tokens(o, ["status"])


@query("mask_phase2", f"""WITH {C} SELECT row_id, yb AS "R", CASE WHEN yb = 1 THEN {srnd('x_true')} END AS x_true,
    CASE WHEN yb = 1 THEN c_true END AS c_true FROM cohort""")
def mask_phase2(spark, d):
    f = fx.cohort(spark, d).select("row_id", F.col("yb").alias("R"), rnd("x_true").alias("x_true"), "c_true")
    return columns.mask_phase2(f, ["x_true", "c_true"])


@query("suffix_columns", "SELECT c_custkey, c_name AS c_name_v, c_acctbal AS c_acctbal_v FROM customer")
def suffix_columns(spark, d):
    return columns.suffix_columns(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "_v", ["c_custkey"])


@query("fill_rules", """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE -1.0 END AS bal,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE c_name END AS seg,
    CASE WHEN c_nationkey <> 3 THEN c_nationkey ELSE 0 END AS nation FROM customer""")
def fill_rules(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("seg"),
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("nation"), "c_name",
    )
    return columns.fill_rules(c, {"bal": [-1.0], "seg": [F.col("c_name"), "Not Specified"], "nation": [0]}).drop("c_name")


FIRSTS_SQL = fx.SUBJECTS_SQL + """,
sp AS (SELECT user_id, min(day) AS start_day, max(day) AS last_day,
              min(CASE WHEN event_type='purchase' THEN day END) AS onset,
              min(CASE WHEN event_type='error' AND value > 200 THEN day END) AS died FROM ev GROUP BY 1)"""


def spans(spark, d):
    e, _ = fx.subjects(spark, d)
    return e.groupBy("user_id").agg(
        F.min("day").alias("start_day"), F.max("day").alias("last_day"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("day"))).alias("onset"),
        F.min(F.when((F.col("event_type") == "error") & (F.col("value") > 200), F.col("day"))).alias("died"),
    )


@query("survival_times", f"""WITH {FIRSTS_SQL} SELECT user_id, CASE WHEN onset IS NOT NULL THEN 1 ELSE 0 END AS event,
    {srnd('coalesce(onset, last_day) - start_day')} AS time, CASE WHEN died IS NOT NULL THEN 1 ELSE 0 END AS death FROM sp""")
def survival_times(spark, d):
    out = columns.survival_times(spans(spark, d), "start_day", "onset", "last_day", "died")
    return out.select("user_id", "event", rnd("time").alias("time"), "death")


RULES = [
    columns.TextRule("licence", (r"licen[cs]e",)),
    columns.TextRule("address", (r"@", r"\."), (r"https?:",)),
    columns.TextRule("link", (r"https?:",)),
    columns.TextRule("article", (r"\bthe\b",), (r"\bun[e]?\b",)),
]


@query("classify_by_rules", r"""WITH t AS (SELECT doc_id, text, regexp_replace(text, 'terms of use', 'license', 'gi') AS s FROM documents)
    SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN NULL
      WHEN regexp_matches(s, 'licen[cs]e', 'i') THEN 'licence'
      WHEN regexp_matches(s, '@', 'i') AND regexp_matches(s, '\.', 'i') AND NOT regexp_matches(s, 'https?:', 'i') THEN 'address'
      WHEN regexp_matches(s, 'https?:', 'i') THEN 'link'
      WHEN regexp_matches(s, '\bthe\b', 'i') AND NOT regexp_matches(s, '\bun[e]?\b', 'i') THEN 'article'
      ELSE 'Other' END AS label FROM t""")
def classify_by_rules(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", columns.classify_by_rules("text", RULES, [("terms of use", "license")]).alias("label"))


@query("design_columns", f"""WITH {C} SELECT row_id, {srnd('(x_true-12)/5')} AS x5, {srnd('(x_true-12)/5*z_bal')} AS x5_bal,
    {', '.join(f"(c_true = '{v}')::INTEGER::DOUBLE AS " + '"c_true_' + v + '"' for v in ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))}
    FROM cohort""")
def design_columns(spark, d):
    f = fx.cohort(spark, d)
    levels = [r[0] for r in columns.level_codes(f, "c_true").orderBy("code").select("c_true").collect()]
    x5 = columns.centred("x_true", 12, 5)
    terms = {"x5": rnd(x5), "x5_bal": rnd(columns.product(x5, F.col("z_bal"))), **columns.dummies("c_true", levels, "1-URGENT")}
    return columns.design_columns(f, terms).select("row_id", *terms)


@query("cut_bins", f"""WITH {C} SELECT row_id, CASE WHEN y <= (SELECT quantile_cont(y, 0.19) FROM cohort) THEN 1
    WHEN y <= (SELECT quantile_cont(y, 0.81) FROM cohort) THEN 2 ELSE 3 END AS outcome_strata,
    CASE WHEN time <= 0.5 THEN 1 WHEN time <= 1 THEN 2 WHEN time <= 2 THEN 3 ELSE 4 END AS time_cut FROM cohort""")
def cut_bins(spark, d):
    f = fx.cohort(spark, d)
    return columns.quantile_bins(f, "y").select("row_id", "outcome_strata", columns.cut_bins("time", [0.5, 1, 2]).alias("time_cut"))


@query("cross_strata", f"""WITH {C} SELECT event::VARCHAR||'.'||(CASE WHEN time<=1 THEN 1 ELSE 2 END)::VARCHAR||'.'||z_seg AS strata,
    count(*) AS n FROM cohort GROUP BY ALL""")
def cross_strata(spark, d):
    f = fx.cohort(spark, d)
    return f.groupBy(columns.cross_strata("event", columns.cut_bins("time", [1]), "z_seg").alias("strata")).agg(F.count("*").alias("n"))


@query("residualize_pairs", f"""WITH {C} SELECT row_id, {srnd('x_star - x_true')} AS resid, {srnd('x_true')} AS restored FROM cohort""")
def residualize_pairs(spark, d):
    f = fx.cohort(spark, d)
    once = columns.residualize_pairs(f, [("x_star", "x_true")])
    back = columns.residualize_pairs(once, [("x_star", "x_true")])
    return once.select("row_id", rnd("x_true").alias("resid")).join(back.select("row_id", rnd("x_true").alias("restored")), "row_id")


@query("null_out_of_range", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 40 THEN l_quantity END AS l_quantity,
    CASE WHEN l_discount <= 0.05 THEN l_discount END AS l_discount FROM lineitem""")
def null_out_of_range(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return columns.null_out_of_range(li, {"l_quantity": 40, "l_discount": 0.05})


@query("complete_cases", f"WITH {FIRSTS_SQL} SELECT user_id FROM sp WHERE onset IS NOT NULL AND died IS NOT NULL")
def complete_cases(spark, d):
    return columns.complete_cases(spans(spark, d), ["onset", "died"]).select("user_id")


@query("split_phases", f"WITH {C} SELECT yb AS phase2, count(*) AS n FROM cohort GROUP BY ALL")
def split_phases(spark, d):
    f = columns.mask_phase2(fx.cohort(spark, d).withColumn("R", F.col("yb")), ["x_true"])
    one, two = columns.split_phases(f, fx.COHORT_ROLES)
    return one.agg(F.lit(0).alias("phase2"), F.count("*").alias("n")).unionByName(two.agg(F.lit(1).alias("phase2"), F.count("*").alias("n")))


BANDS = {"1": (10.0, 20.0), "2": (20.0, 35.0), "3": (35.0, 50.0)}


@query("draw_in_band", f"""SELECT l_orderkey, l_linenumber, {srnd("CASE l_linenumber WHEN 1 THEN 10+10*" + fx.skey(7, 'v', 'l_orderkey', 'l_linenumber')
    + " WHEN 2 THEN 20+15*" + fx.skey(7, 'v', 'l_orderkey', 'l_linenumber') + " WHEN 3 THEN 35+15*" + fx.skey(7, 'v', 'l_orderkey', 'l_linenumber') + " END")} AS v FROM lineitem""")
def draw_in_band(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("|", "l_orderkey", "l_linenumber").alias("k"))
    return columns.draw_in_band(li, "l_linenumber", BANDS, "k", 7, "v").select("l_orderkey", "l_linenumber", rnd("v").alias("v"))


@query("range_midpoint", f"""SELECT p_brand AS variant, p_type AS trait, {srnd('avg(p_size + 2.5)')} AS midpoint
    FROM part WHERE p_type IN ('ECONOMY','PROMO','LARGE') GROUP BY ALL""")
def range_midpoint(spark, d):
    p = table(spark, d, "part").where(F.col("p_type").isin("ECONOMY", "PROMO", "LARGE"))
    text = F.concat(F.lit("size "), F.col("p_size"), F.lit(" - "), F.col("p_size") + 5, F.lit(" mm"))
    return p.groupBy(F.col("p_brand").alias("variant"), F.col("p_type").alias("trait")).agg(
        rnd(F.avg(columns.range_midpoint(text))).alias("midpoint")
    )


# ---------------------------------------------------------------- joins

@query("spine_join", f"""WITH {fx.SUBJECTS_SQL},
    f1 AS (SELECT * FROM ev WHERE event_type='purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day, event_id)=1),
    f2 AS (SELECT * FROM ev WHERE event_type='error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day, event_id)=1)
    SELECT u.user_id::VARCHAR AS user_id, f1.event_id AS event_id_v, f1.value AS value_v, f2.event_id AS event_id_nv, f2.value AS value_nv
    FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN f1 USING (user_id) LEFT JOIN f2 USING (user_id)""")
def spine_join(spark, d):
    e, _ = fx.subjects(spark, d)
    e = e.drop("props")
    parts = []
    for kind, suffix in (("purchase", "_v"), ("error", "_nv")):
        first = joins.first_per_key(e.where(F.col("event_type") == kind), "user_id", ["day", "event_id"])
        parts.append(columns.suffix_columns(first.select("user_id", "event_id", "value"), suffix, ["user_id"]))
    return joins.spine_join(e.select("user_id").distinct(), parts, "user_id")


@query("exclude_subjects", """WITH bad AS (SELECT DISTINCT user_id FROM events WHERE value > 250)
    SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM bad)""")
def exclude_subjects(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("value") <= 250, F.col("value")).alias("v"))
    return joins.exclude_subjects(e, "user_id", "v").select("event_id", "user_id")


@query("first_per_key", f"""WITH {fx.SUBJECTS_SQL} SELECT user_id, event_id, value FROM ev WHERE event_type='purchase'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day, event_id)=1""")
def first_per_key(spark, d):
    e, _ = fx.subjects(spark, d)
    return joins.first_per_key(e.where(F.col("event_type") == "purchase"), "user_id", ["day", "event_id"], "day").select(
        "user_id", "event_id", "value"
    )


@query("window_nearest", f"""WITH {fx.SUBJECTS_SQL}, idx AS (SELECT event_id, user_id, day FROM ev WHERE event_type='purchase'),
    hit AS (SELECT i.event_id, f.value, row_number() OVER (PARTITION BY i.event_id ORDER BY abs(f.day-i.day), f.day, f.event_id) AS rn
      FROM idx i JOIN ev f ON f.user_id=i.user_id AND f.event_type='view'
       AND f.day >= (i.day+1) + (-0.5::DOUBLE) AND f.day <= (i.day+1) + 0.25::DOUBLE)
    SELECT i.event_id, i.user_id, h.value AS nearest FROM idx i LEFT JOIN (SELECT * FROM hit WHERE rn=1) h USING (event_id)""")
def window_nearest(spark, d):
    e, facts = fx.subjects(spark, d)
    idx = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "day", (F.col("day") + 1).alias("target"))
    return joins.window_nearest(
        idx, facts, "user_id", "event_id", "target", "day", "day", "value", "event_id", -0.5, 0.25, "nearest"
    ).select("event_id", "user_id", "nearest")


@query("alias_join", """WITH a AS (SELECT lower(n_name) AS alias, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0),
    t AS (SELECT c_custkey, lower(n_name) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, coalesce(a.canonical, t.name) AS test FROM t LEFT JOIN a ON a.alias = t.name
    WHERE coalesce(a.canonical, t.name) IN ('AFRICA','EUROPE','nation_1','nation_3')""")
def alias_join(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    alias = n.join(r, n.n_regionkey == r.r_regionkey).where("n_nationkey % 2 = 0").select(
        F.lower("n_name").alias("alias"), F.col("r_name").alias("canonical")
    )
    c = table(spark, d, "customer")
    t = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")).alias("test"))
    return joins.alias_join(t, "test", alias, ["AFRICA", "EUROPE", "nation_1", "nation_3"])


@query("attach_group_stats", f"""WITH {C} SELECT row_id, count(*) OVER (PARTITION BY c_star) AS n, {srnd('avg(y) OVER (PARTITION BY c_star)')} AS y_bar FROM cohort""")
def attach_group_stats(spark, d):
    f = fx.cohort(spark, d).select("row_id", "c_star", "y")
    out = joins.attach_group_stats(f, "c_star", {"n": F.count("*"), "y_bar": F.avg("y")})
    return out.select("row_id", "n", rnd("y_bar").alias("y_bar"))


@query("attach_weights", f"""WITH {C} SELECT row_id, {srnd('count(*) OVER (PARTITION BY z_seg)/100.0::DOUBLE')} AS "W" FROM cohort""")
def attach_weights(spark, d):
    f = fx.cohort(spark, d).select("row_id", "z_seg")
    w = f.groupBy("z_seg").agg((F.count("*") / 100.0).alias("W"))
    return joins.attach_weights(f, "z_seg", w).select("row_id", rnd("W").alias("W"))


@query("attach_truth", f"""WITH {fx.ESTIMATES_SQL}, {fx.TRUTH_SQL} SELECT rep, design, method, term, {srnd('estimate - truth')} AS diff FROM estimates JOIN truth USING (term)""")
def attach_truth(spark, d):
    out = joins.attach_truth(fx.estimates(spark, d), fx.truth(spark, d))
    return out.select("rep", "design", "method", "term", rnd(F.col("estimate") - F.col("truth")).alias("diff"))


@query("pareto_front", f"""WITH {fx.TRIALS_SQL} SELECT trial_number, avg_mse, avg_ed FROM trials a WHERE NOT EXISTS (SELECT 1 FROM trials b
    WHERE b.avg_mse <= a.avg_mse AND b.avg_ed <= a.avg_ed AND (b.avg_mse < a.avg_mse OR b.avg_ed < a.avg_ed))""")
def pareto_front(spark, d):
    return joins.pareto_front(fx.trials(spark, d).select("trial_number", "avg_mse", "avg_ed"), "avg_mse", "avg_ed")


@query("knn_donors", f"""WITH {C}, don AS MATERIALIZED (SELECT row_id AS donor, x_star AS p, row_number() OVER (ORDER BY x_star, row_id) AS rk FROM cohort WHERE yb = 1),
    al AS (SELECT row_id, x_star AS p, count(*) FILTER (WHERE yb = 1) OVER (ORDER BY x_star, row_id) AS pos, yb FROM cohort),
    cand AS (SELECT a.row_id, d.donor, abs(d.p - a.p) AS dist FROM (SELECT row_id, p, unnest(range(pos - 9, pos + 11)) AS rk FROM al WHERE yb = 0) a JOIN don d USING (rk))
    SELECT row_id, donor, {srnd('dist', 9)} AS distance, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, donor) AS rn FROM cand) WHERE rn <= 5""")
def knn_donors(spark, d):
    f = fx.cohort(spark, d)
    don = f.where("yb = 1").select(F.col("row_id").alias("donor"), F.col("x_star").alias("p"))
    rec = f.where("yb = 0").select("row_id", F.col("x_star").alias("p"))
    return joins.knn_donors(don, rec, "donor", "row_id", "p", 5).select("row_id", "donor", rnd("distance", 9).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("align_rows", "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def align_rows(spark, d):
    return joins.align_rows(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id")


@query("dedupe_join", """SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) o ON o.o_custkey = c_custkey""")
def dedupe_join(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return joins.dedupe_join(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("remaining_rows", f"WITH {C} SELECT row_id FROM cohort WHERE NOT ({fx.skey(5, 'pilot', 'row_id')} < 0.1::DOUBLE)")
def remaining_rows(spark, d):
    f = fx.cohort(spark, d).select("row_id")
    return joins.remaining_rows(f, f.where(uniform(5, "pilot", "row_id") < 0.1), "row_id")


# ---------------------------------------------------------------- aggregates

@query("crosstab", f"WITH {C} SELECT c_true, c_star, count(*) AS n, {srnd('count(*) / sum(count(*)) OVER ()')} AS share FROM cohort GROUP BY ALL")
def crosstab(spark, d):
    return aggregates.crosstab(fx.cohort(spark, d), "c_true", "c_star").withColumn("share", rnd("share"))


@query("agreement", f"WITH {C} SELECT {srnd('avg((c_true = c_star)::INTEGER)')} AS agreement FROM cohort")
def agreement(spark, d):
    return aggregates.agreement(fx.cohort(spark, d), "c_true", "c_star").select(rnd("agreement").alias("agreement"))


@query("stratum_moments", f"WITH {C} SELECT c_star, count(*) AS n, {srnd('avg(y)')} AS mean, {srnd('var_samp(y)')} AS variance FROM cohort GROUP BY ALL")
def stratum_moments(spark, d):
    return aggregates.stratum_moments(fx.cohort(spark, d), "c_star", "y").select("c_star", "n", rnd("mean").alias("mean"), rnd("variance").alias("variance"))


@query("collapse_entity", f"WITH {fx.SUBJECTS_SQL} SELECT user_id, {srnd('avg(value)')} AS value, arg_min(event_type, (day, event_id)) AS event_type FROM ev GROUP BY 1")
def collapse_entity(spark, d):
    e, _ = fx.subjects(spark, d)
    return aggregates.collapse_entity(e, "user_id", ["value"], ["event_type"], ["day", "event_id"]).withColumn("value", rnd("value"))


@query("pivot_first", f"""WITH {fx.SUBJECTS_SQL} SELECT user_id, floor(day)::BIGINT AS on_day,
    arg_min(value, (day, event_id)) FILTER (WHERE event_type='view') AS view, arg_min(value, (day, event_id)) FILTER (WHERE event_type='click') AS click,
    arg_min(value, (day, event_id)) FILTER (WHERE event_type='purchase') AS purchase FROM ev GROUP BY 1, 2""")
def pivot_first(spark, d):
    e, _ = fx.subjects(spark, d)
    e = e.withColumn("on_day", F.floor("day"))
    return aggregates.pivot_first(e, ["user_id", "on_day"], "event_type", "value", ["view", "click", "purchase"], ["day", "event_id"])


@query("pairwise_covariance", f"""WITH {C}, m AS (SELECT CASE WHEN yb=1 THEN x_true END AS x_true, CASE WHEN event=1 THEN y END AS y, z_bal FROM cohort)
    SELECT 'x_true' AS "row", 'x_true' AS col, {srnd('covar_samp(x_true,x_true)')} AS value FROM m
    UNION ALL SELECT 'x_true','y',{srnd('covar_samp(x_true,y)')} FROM m UNION ALL SELECT 'y','x_true',{srnd('covar_samp(x_true,y)')} FROM m
    UNION ALL SELECT 'x_true','z_bal',{srnd('covar_samp(x_true,z_bal)')} FROM m UNION ALL SELECT 'z_bal','x_true',{srnd('covar_samp(x_true,z_bal)')} FROM m
    UNION ALL SELECT 'y','y',{srnd('covar_samp(y,y)')} FROM m UNION ALL SELECT 'y','z_bal',{srnd('covar_samp(y,z_bal)')} FROM m
    UNION ALL SELECT 'z_bal','y',{srnd('covar_samp(y,z_bal)')} FROM m UNION ALL SELECT 'z_bal','z_bal',{srnd('covar_samp(z_bal,z_bal)')} FROM m""")
def pairwise_covariance(spark, d):
    f = fx.cohort(spark, d).select(F.when(F.col("yb") == 1, F.col("x_true")).alias("x_true"), F.when(F.col("event") == 1, F.col("y")).alias("y"), "z_bal")
    return aggregates.pairwise_covariance(f, ["x_true", "y", "z_bal"]).withColumn("value", rnd("value"))


# Three columns that share rows in pairs only: their pairwise correlations cannot all hold.
_CLASH = {
    "a": (("event = 1 AND yb = 1 OR event = 0", "x_true"),),
    "b": (("event = 1 AND yb = 1", "x_true"), ("event = 1 AND yb = 0", "x_true")),
    "c": (("event = 0", "x_true"), ("event = 1 AND yb = 0", "-x_true")),
}


def _clash_sql(name):
    return "CASE " + " ".join(f"WHEN {w} THEN {v}" for w, v in _CLASH[name]) + " END"


@query("repaired_covariance", f"""WITH {C}, m AS (SELECT {', '.join(f'{_clash_sql(n)} AS {n}' for n in _CLASH)} FROM cohort),
    k AS (SELECT covar_samp(a,a) AS aa, covar_samp(b,b) AS bb, covar_samp(c,c) AS cc, covar_samp(a,b) AS ab, covar_samp(a,c) AS ac, covar_samp(b,c) AS bc FROM m),
    t AS (SELECT *, (aa+bb+cc)/3 AS q, sqrt(((aa-(aa+bb+cc)/3)^2 + (bb-(aa+bb+cc)/3)^2 + (cc-(aa+bb+cc)/3)^2 + 2*(ab*ab+ac*ac+bc*bc))/6) AS p FROM k),
    u AS (SELECT *, ((aa-q)*((bb-q)*(cc-q)-bc*bc) - ab*(ab*(cc-q)-bc*ac) + ac*(ab*bc-(bb-q)*ac))/(2*p^3) AS half FROM t),
    e AS (SELECT *, acos(least(greatest(half, -1), 1))/3 AS phi FROM u),
    v AS (SELECT *, q + 2*p*cos(phi) AS e1, q + 2*p*cos(phi + 2*pi()/3) AS e3 FROM e), w AS (SELECT *, 3*q - e1 - e3 AS e2 FROM v)
    SELECT e3 < -1e-8 AS repaired, true AS symmetric, {srnd('greatest(e1, 1e-8) + greatest(e2, 1e-8) + greatest(e3, 1e-8)')} AS trace, {srnd('greatest(e3, 1e-8)', 7)} AS smallest,
      {srnd('greatest(e1, 1e-8)')} AS largest FROM w""")
def repaired_covariance(spark, d):
    """Trace, symmetry and extreme eigenvalues, which SQL knows in closed form."""
    import numpy as np

    f = fx.cohort(spark, d).select(*[F.expr(_clash_sql(n)).alias(n) for n in _CLASH])
    before = {(r["row"], r["col"]): r["value"] for r in aggregates.pairwise_covariance(f, list(_CLASH)).collect()}
    after = {(r["row"], r["col"]): r["value"] for r in aggregates.repaired_covariance(f, list(_CLASH)).collect()}
    old, new = (np.array([[m[a, b] for b in _CLASH] for a in _CLASH]) for m in (before, after))
    vals = np.linalg.eigvalsh(new)
    row = (bool(np.linalg.eigvalsh(old).min() < -1e-8), bool((new == new.T).all()), float(np.trace(new)), float(vals[0]), float(vals[-1]))
    out = spark.createDataFrame([row], "repaired boolean, symmetric boolean, trace double, smallest double, largest double")
    return out.withColumns({"trace": rnd("trace"), "smallest": rnd("smallest", 7), "largest": rnd("largest")})


@query("error_matrix", f"""WITH {C}, k AS (SELECT c_true AS given, c_star AS level, count(*) AS n FROM cohort GROUP BY 1, 2)
    SELECT *, {srnd('n/sum(n) OVER (PARTITION BY given)')} AS prob FROM k""")
def error_matrix(spark, d):
    return aggregates.error_matrix(fx.cohort(spark, d), "c_star", "c_true").withColumn("prob", rnd("prob"))


@query("error_matrix_smoothed", f"""WITH {C}, l AS (SELECT DISTINCT c_true AS v FROM cohort UNION SELECT DISTINCT c_star FROM cohort),
    k AS (SELECT a.v AS given, b.v AS level FROM l a, l b), n AS (SELECT c_star AS given, c_true AS level, count(*) AS c FROM cohort GROUP BY ALL)
    SELECT given, level, coalesce(c,0)+1 AS n, {srnd('(coalesce(c,0)+1)/sum(coalesce(c,0)+1) OVER (PARTITION BY given)')} AS prob FROM k LEFT JOIN n USING (given, level)""")
def error_matrix_smoothed(spark, d):
    return aggregates.error_matrix(fx.cohort(spark, d), "c_star", "c_true", "p2_given_p1", True).withColumn("prob", rnd("prob"))


@query("unpivot_terms", f"WITH {C} SELECT row_id, 'x_true' AS term, {srnd('x_true')} AS estimate FROM cohort UNION ALL SELECT row_id, 'x_star', {srnd('x_star')} FROM cohort")
def unpivot_terms(spark, d):
    f = fx.cohort(spark, d).select("row_id", "x_true", "x_star")
    return aggregates.unpivot_terms(f, ["row_id"], ["x_true", "x_star"]).withColumn("estimate", rnd("estimate"))


@query("correlation", f"WITH {C} SELECT {srnd('corr(x_true, x_star)')} AS correlation, {srnd('avg((x_true <> x_star)::INTEGER)')} AS mismatch FROM cohort")
def correlation(spark, d):
    return aggregates.correlation(fx.cohort(spark, d), "x_true", "x_star").select(rnd("correlation").alias("correlation"), rnd("mismatch").alias("mismatch"))


@query("quantiles", f"""WITH {C}, q AS (SELECT c_star, quantile_cont(y, [0.05, 0.25, 0.5, 0.75, 0.95]) AS v FROM cohort GROUP BY 1)
    SELECT c_star, unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS prob, {srnd('unnest(v)')} AS value FROM q""")
def quantiles(spark, d):
    q = order.exact_quantiles(fx.cohort(spark, d), "y", [0.05, 0.25, 0.5, 0.75, 0.95], ["c_star"])
    return q.withColumn("value", rnd("value"))


@query("category_profile", f"""WITH {C}, c0 AS (SELECT 'c_true' AS "column", c_true AS level, count(*) AS n FROM cohort GROUP BY 2
      UNION ALL SELECT 'c_star', c_star, count(*) FROM cohort GROUP BY 2 UNION ALL SELECT 'z_seg', z_seg, count(*) FROM cohort GROUP BY 2),
    c1 AS (SELECT * FROM c0 UNION ALL SELECT CASE "column" WHEN 'c_true' THEN 'c_star' ELSE 'c_true' END, level, 0 FROM c0 WHERE "column" <> 'z_seg'),
    c2 AS (SELECT "column", level, sum(n)::BIGINT AS n FROM c1 GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) = 1 AND n > 0 AS is_mode FROM c2""")
def category_profile(spark, d):
    return aggregates.category_profile(fx.cohort(spark, d), ["c_true", "c_star", "z_seg"], [("c_star", "c_true")])


# ---------------------------------------------------------------- windows and top-k

@query("ecdf_midrank", f"""WITH v AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_quantity, {srnd('(sum(n) OVER (ORDER BY l_quantity) - 0.5::DOUBLE*n)/sum(n) OVER ()', 9)} AS midrank FROM v""")
def ecdf_midrank(spark, d):
    return aggregates.ecdf_midrank(table(spark, d, "lineitem"), "l_quantity").withColumn("midrank", rnd("midrank", 9))


@query("tail_positions", f"WITH {C} SELECT row_id, row_number() OVER (ORDER BY y, row_id) AS position FROM cohort")
def tail_positions(spark, d):
    f = fx.cohort(spark, d).select("row_id", "y").withColumn("_one", F.lit(1))
    return order.running_sums(f, ["y", "row_id"], {"position": "_one"}).select("row_id", "position")


@query("fold_assign", f"SELECT o_orderkey, (row_number() OVER (ORDER BY {fx.skey(11, 'fold', 'o_orderkey')}, o_orderkey) - 1) % 5 AS fold FROM orders")
def fold_assign(spark, d):
    from phasewise.operators.resampling import fold_assign as assign

    return assign(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5, 11)


@query("two_tail_select", f"""WITH {C}, r AS (SELECT row_id, row_number() OVER (ORDER BY y, row_id) AS p, count(*) OVER () AS n FROM cohort)
    SELECT row_id FROM r WHERE p <= floor(n*0.05)//2 OR p > n - floor(n*0.05)//2""")
def two_tail_select(spark, d):
    from phasewise.operators.designs import two_tail

    f = fx.cohort(spark, d).select("row_id", "y")
    n = int(f.count() * 0.05)
    return two_tail(f, "y", "row_id", n).where("R = 1").select("row_id")


@query("rank_to_utopia", f"""WITH {fx.TRIALS_SQL}, front AS (SELECT * FROM trials a WHERE NOT EXISTS (SELECT 1 FROM trials b
      WHERE b.avg_mse <= a.avg_mse AND b.avg_ed <= a.avg_ed AND (b.avg_mse < a.avg_mse OR b.avg_ed < a.avg_ed))),
    r AS (SELECT min(avg_mse) AS m0, max(avg_mse) AS m1, min(avg_ed) AS e0, max(avg_ed) AS e1 FROM front)
    SELECT trial_number, {srnd('sqrt(((avg_mse-m0)/(m1-m0))^2 + ((avg_ed-e0)/(e1-e0))^2)')} AS distance FROM front, r ORDER BY distance, trial_number LIMIT 5""")
def rank_to_utopia(spark, d):
    from phasewise.operators.tuning import rank_to_utopia as rank

    return rank(fx.trials(spark, d), "avg_mse", "avg_ed", "trial_number", 5).select("trial_number", rnd("distance").alias("distance"))


@query("argmin_per_key", f"WITH {fx.SUBJECTS_SQL} SELECT user_id, event_type, arg_min(event_id, (value, event_id)) AS event_id FROM ev GROUP BY 1, 2")
def argmin_per_key(spark, d):
    e, _ = fx.subjects(spark, d)
    return e.groupBy("user_id", "event_type").agg(aggregates.first_value("event_id", F.struct("value", "event_id")).alias("event_id"))


# ---------------------------------------------------------------- scalar functions

@query("expit_logit", f"WITH {C} SELECT row_id, {srnd('1/(1+exp(-(y-7)*3))')} AS p, {srnd('y-7')} AS back FROM cohort")
def expit_logit(spark, d):
    f = fx.cohort(spark, d)
    return f.select("row_id", rnd(scalar.expit((F.col("y") - 7) * 3)).alias("p"), rnd(scalar.logit(scalar.expit(F.col("y") - 7))).alias("back"))


@query("egfr", f"""WITH b AS (SELECT l_orderkey, l_linenumber, (40 + l_quantity*2)/88.4::DOUBLE AS scr, 20 + l_linenumber*8 AS age, l_returnflag = 'A' AS f FROM lineitem),
    k AS (SELECT *, scr/(CASE WHEN f THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END) AS q, CASE WHEN f THEN -0.329::DOUBLE ELSE -0.411::DOUBLE END AS al FROM b)
    SELECT l_orderkey, l_linenumber,
      least(round(142*least(q,1)^al*greatest(q,1)^(-1.2::DOUBLE)*0.9938::DOUBLE^age*(CASE WHEN f THEN 1.012::DOUBLE ELSE 1 END)), 140) AS clean,
      {srnd("least(141*least(q,1)^al*greatest(q,1)^(-1.209::DOUBLE)*0.993::DOUBLE^age*(CASE WHEN f THEN 1.018::DOUBLE ELSE 1 END), 140)")} AS noisy FROM k""")
def egfr(spark, d):
    li = table(spark, d, "lineitem")
    args = (F.lit(40) + F.col("l_quantity") * 2, F.lit(20) + F.col("l_linenumber") * 8, F.col("l_returnflag") == "A")
    return li.select("l_orderkey", "l_linenumber", scalar.egfr(*args, "clean").alias("clean"), rnd(scalar.egfr(*args, "noisy")).alias("noisy"))


@query("soft_range", f"""WITH {C}, s AS (SELECT avg(y) AS m, stddev_samp(y) AS s FROM cohort)
    SELECT row_id, {srnd('40 + 60/(1+exp(-(ln((70-40)/60/(1-(70-40)/60)) + 10/(60*0.5*0.5)*(y-m)/s)))')} AS v FROM cohort, s""")
def soft_range(spark, d):
    f = fx.cohort(spark, d).select("row_id", "y")
    m = f.agg(F.avg("y"), F.stddev_samp("y")).first()
    return f.select("row_id", rnd(scalar.soft_range(F.col("y"), m[0], m[1], 70, 10, 40, 100)).alias("v"))


@query("soft_max2", f"WITH {C} SELECT row_id, {srnd('ln(exp(y)+exp(x_star))')} AS v FROM cohort")
def soft_max2(spark, d):
    return fx.cohort(spark, d).select("row_id", rnd(scalar.soft_max2(F.col("y"), F.col("x_star"))).alias("v"))


@query("bmi_hazard_ratio", f"""SELECT p_partkey, {srnd('p_size/((1+p_retailprice/2000)*(1+p_retailprice/2000))')} AS bmi,
    {srnd('exp(p_size/100*5)')} AS hr FROM part""")
def bmi_hazard_ratio(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", rnd(scalar.bmi(F.col("p_size"), F.lit(1) + F.col("p_retailprice") / 2000)).alias("bmi"),
                    rnd(scalar.hazard_ratio(F.col("p_size") / 100, 5)).alias("hr"))


@query("normal_functions", f"""WITH {C} SELECT row_id, {srnd('exp(-0.5::DOUBLE*(y-7)*(y-7))/sqrt(2*pi())', 9)} AS pdf, {srnd('y-7', 7)} AS round_trip FROM cohort""")
def normal_functions(spark, d):
    # Each step is its own column: nested expressions would repeat their input many times.
    f = fx.cohort(spark, d).withColumn("z", F.col("y") - 7).withColumn("p", scalar.norm_cdf(F.col("z")))
    return f.select("row_id", rnd(scalar.norm_pdf(F.col("z")), 9).alias("pdf"), rnd(scalar.norm_ppf(F.col("p")), 7).alias("round_trip"))
