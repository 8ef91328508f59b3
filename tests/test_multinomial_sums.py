"""Multinomial fits add up by batch; drawn levels come from plain columns."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from phasewise.functions.keyed import normal, uniform
from phasewise.imputation import draws
from phasewise.models import multinomial

LEVELS = ["a", "b", "c"]


def test_a_batch_gives_one_row_a_group():
    rng = np.random.default_rng(1)
    n, m, p, by = 300, 2, 2, ["g"]
    g, k, w, x = rng.integers(0, 4, n), rng.integers(0, 3, n).astype(np.int32), rng.uniform(0.5, 2, n), np.column_stack([np.ones(n), rng.normal(size=n)])
    beta = rng.normal(size=(4, m * p))
    blocks, pairs = [(0, 0), (0, 1), (1, 1)], [(0, 0), (0, 1), (1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(g), pa.array(beta[g].tolist()), pa.array(np.zeros(n)), pa.array(k), pa.array(w), *[pa.array(c) for c in x.T]],
                                       names=["g", "_beta", "_before", "_k", "_w", "x0", "x1"])
    out = [b.to_pandas() for b in multinomial._sums(by, ["x0", "x1"], m, blocks, pairs)([batch.slice(0, 0), batch])]
    assert len(out) == 1 and sorted(out[0]["g"]) == [0, 1, 2, 3]
    for r in out[0].to_dict("records"):
        want, at = np.zeros(14), np.flatnonzero(g == r["g"])
        assert r["_c"] == len(at) and np.allclose(r["_beta"], beta[r["g"]])
        for i in at:
            e = np.exp(np.concatenate([[0.0], beta[r["g"]].reshape(m, p) @ x[i]]))
            q = e / e.sum()
            want[:4] += w[i] * np.concatenate([((k[i] == c + 1) - q[c + 1]) * x[i] for c in range(m)])
            want[4:13] += w[i] * np.array([(q[c + 1] * ((c == d) - q[d + 1])) * x[i, a] * x[i, b] for c, d in blocks for a, b in pairs])
            want[13] += w[i] * np.log(q[k[i]])
        assert np.allclose([r[f"_t{j}"] for j in range(14)], want)


def test_picked_levels_equal_the_probability_walk(spark):
    df = spark.range(0, 900, 1, 3).withColumn("imp_id", (F.col("id") % 3 + 1).cast("int")).withColumn("x", normal(1, "x", "id"))
    df = df.withColumn("y", F.when(F.col("x") + normal(1, "e", "id") > 0.8, "c").when(normal(1, "f", "id") > 0, "b").otherwise("a"))
    for by in (["imp_id"], []):
        fit = multinomial.fit_multinomial(df, "y", LEVELS, ["x"], by=by)
        odd = df.withColumn("x", F.when(F.col("id") % 10 > 0, F.col("x")))  # a null term keeps its level as before
        u = uniform(4, "u", "id")
        got = fit.pick(odd, u, "level")
        assert got.columns == [*odd.columns, "level"] or set(got.columns) == {*odd.columns, "level"}
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()  # array functions by lambda are not compiled
        want = fit.probabilities(odd, "_prob").withColumn("want", draws.pick_level(LEVELS, "_prob", u)).select("id", "want")
        both = got.join(want, "id")
        assert both.count() == 900 and both.where("NOT level <=> want").count() == 0 and both.select("level").distinct().count() == 3
