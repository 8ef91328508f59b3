"""Text rules, typing and roles on small tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasewise.operators import columns
from phasewise.operators.columns import Roles
from phasewise.plans.presets import DIAGNOSIS_RULES, HISTORY_PHRASES
from phasewise.sources import tables


def test_diagnosis_rules(spark):
    cases = {
        "Pneumocystis pneumonia": "PCP",
        "H/O tuberculosis": "Latent TB / History (Non-ADE)",
        "CMV retinitis": "CMV End-Organ Disease (ADE)",
        "CMV viremia": "CMV Viremia/NOS (Non-ADE)",
        "Hodgkin lymphoma": "Other",
        "non-Hodgkin lymphoma": "Lymphoma (AIDS-Defining)",
        "B-cell lymphoma": "Lymphoma (AIDS-Defining)",
        "Lobar pneumonia": "Bacterial Pneumonia (Single/Unspecified)",
        "broken arm": "Other",
        " ": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", columns.classify_by_rules("t", DIAGNOSIS_RULES, HISTORY_PHRASES).alias("c")).collect()}
    assert got == cases


def test_template_types(spark):
    df = spark.createDataFrame([("1", "TRUE", "a", "7.9"), ("x", "0", "q", None), (None, "1", None, "2")], "n string, b string, f string, i string")
    out = columns.cast_to_template(df, T.StructType.fromDDL("n double, b boolean, i int"), {"f": ["a", "b"]}).collect()
    assert [tuple(r) for r in out] == [(1.0, True, "a", 7), (None, False, None, None), (None, True, None, 2)]


def test_safe_numeric_is_all_or_nothing(spark):
    df = spark.createDataFrame([("10", "b"), ("2.5", "a"), (None, "b")], "u string, v string")
    assert [tuple(r) for r in columns.safe_numeric(df, ["u", "v"]).collect()] == [(10.0, 2.0), (2.5, 1.0), (None, 2.0)]


def test_roles_by_design():
    r = Roles("id", (("xs", "x"), ("ts", "t")), ("x", "xs", "t", "ts"))
    assert "rs" in r.for_design("RS").numeric and "outcome_strata" in r.for_design("Neyman_INF").categorical
    e = r.exposure_only(["t"])
    assert e.pairs == (("xs", "x"),) and "ts" not in e.numeric


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.1,), (None,)], "v double")
    assert [r[0] for r in df.select(columns.cut_bins("v", [1, 2])).collect()] == [1, 2, 3, None]


def test_samples_overwrite_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "s")
    base = spark.createDataFrame([("t", "SRS", 1, 5), ("t", "SRS", 2, 6)], "type string, design string, rep int, v int")
    tables.write_samples(base, path)
    tables.write_samples(base.where("rep = 2").withColumn("v", F.lit(9)), path)
    assert sorted((r["rep"], r["v"]) for r in tables.read_samples(spark, path).collect()) == [(1, 5), (2, 9)]
    todo = tables.pending_work(spark.range(1, 4).select(F.col("id").cast("int").alias("rep")), tables.read_samples(spark, path), ["rep"])
    assert [r[0] for r in todo.collect()] == [3]
