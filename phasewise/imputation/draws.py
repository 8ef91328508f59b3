"""Draws for one target at a time on stacked tables (column ``imp_id`` numbers the imputations).

Each step fits all imputations in one grouped job, draws the parameters on the tiny result rows,
and fills missing values by a row expression or a distributed donor join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.functions.keyed import chisq_value, normal, normal_value, uniform
from phasewise.functions.scalar import expit
from phasewise.models import linear, multinomial, trees
from phasewise.models.linear import Fit
from phasewise.operators.joins import nearest_donors, number_runs
from phasewise.operators.order import uniform_rank
from phasewise.session import cut, join_small, per_row_numpy

# Ridge of the posterior draw and number of donors.
RIDGE = 1e-5
DONORS = 5


def stack_copies(df: DataFrame, m: int) -> DataFrame:
    """m copies side by side."""
    return df.withColumn("imp_id", F.explode(F.sequence(F.lit(1), F.lit(int(m)))))


def cholesky(v: np.ndarray) -> np.ndarray:
    """Root of a covariance; of a singular one by its eigenvalues."""
    v = (v + v.T) / 2
    try:
        return np.linalg.cholesky(v)
    except np.linalg.LinAlgError:
        vals, vecs = np.linalg.eigh(v)
        return vecs * np.sqrt(np.maximum(vals, 0.0))


def posterior_draw(fit: Fit, seed, tag: str) -> Fit:
    """Draw coefficients (and the residual SD for a linear fit) per group from their posterior.

    Coefficients add the Cholesky root of their covariance times keyed normals ``tag|b0``, ``tag|b1``..; the
    residual sum of squares is divided by a keyed chi-square ``tag|s``. A group's draw depends on its key alone.
    """
    p = len(fit.terms)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.copy()
        betas, sds = [], []
        for r in pdf.itertuples(index=False):
            key = [getattr(r, b) for b in fit.by]
            v = np.asarray(r.bread, float).reshape(p, p)
            beta = np.asarray(r.beta, float)
            if fit.kind == "lm":
                prec = np.linalg.pinv(v)
                v = np.linalg.inv(prec + RIDGE * np.diag(np.diag(prec)))
                sd = np.sqrt(r.rss / chisq_value(max(r.df, 1.0), seed, f"{tag}|s", *key))
            else:
                sd = 1.0
            z = np.array([normal_value(seed, f"{tag}|b{j}", *key) for j in range(p)])
            betas.append(beta + sd * (cholesky(v) @ z))
            sds.append(sd)
        out["beta"] = betas
        out["dispersion"] = sds
        return out

    table, small, _ = per_row_numpy(fit.table, draw, fit.table.schema)
    return Fit(fit.kind, fit.family, fit.terms, fit.by, table, small, fit.y, fit.weight)


def attach_draw(fit: Fit, df: DataFrame) -> DataFrame:
    """Add ``_beta`` (drawn) and ``_sd`` per imputation."""
    t = fit.table.select(*fit.by, F.col("beta").alias("_beta"), F.col("dispersion").alias("_sd"))
    return join_small(df, t, fit.by)


def draw_norm(df: DataFrame, target: str, terms: Mapping[str, Column] | Sequence[str], missing: str, key: str, seed, tag: str,
              weight: str | None = None) -> DataFrame:
    """Bayesian linear draw: value = x'beta* + sd* z for rows flagged ``missing``."""
    fit = linear.fit_lm(df.where(~F.col(missing)), target, terms, weight, by=["imp_id"])
    star = posterior_draw(fit, seed, f"{tag}|{target}")
    d = attach_draw(star, df)
    value = linear.eta(star.terms) + F.col("_sd") * normal(seed, f"{tag}|{target}|e", "imp_id", key)
    return d.withColumn(target, F.when(F.col(missing), value).otherwise(F.col(target))).drop("_beta", "_sd")


def match_donors(df: DataFrame, target: str, donor_pred: str, missing: str, key: str, seed, tag: str, k: int = DONORS,
                 preds: DataFrame | None = None, tied: bool = False) -> DataFrame:
    """Random one of the k donors nearest in ``donor_pred``; copies its observed value.

    ``preds`` may hold the predictions in a table of its own (imp_id, key, target, ``missing``, ``donor_pred``), which is read four times.
    ``tied`` says that many recipients share a prediction, as trees give: its nearest places are then looked for once, not by the row.

    Donors of one prediction are a run. The k nearest places are picked from first, then each
    recipient draws its own donor inside the run, so tied donors all serve.
    """
    by = ["imp_id"]
    rows = df if preds is None else preds
    donors = rows.where(~F.col(missing)).where(F.col(donor_pred).isNotNull()).select(
        *by, F.col(key).alias("_donor"), F.col(donor_pred).alias("_p"), F.col(target).alias("_dv"))
    recipients = rows.where(F.col(missing)).select(*by, key, F.col(donor_pred).alias("_p"))
    runs = donors.groupBy(*by, "_p").agg(F.count("*").alias("_size"))
    slots = runs.withColumn("_slot", F.explode(F.sequence(F.lit(1), F.least("_size", F.lit(k)).cast("int"))))
    slots = slots.select(*by, "_p", F.struct(F.col("_p").alias("p"), F.col("_slot").alias("slot"), F.col("_size").alias("size")).alias("_donor"))
    if tied:
        asks = recipients.where(F.col("_p").isNotNull()).select(*by, "_p", F.col("_p").alias("_ask")).distinct()
        found = nearest_donors(slots, asks, "_donor", "_ask", "_p", k, by)
        near = join_small(recipients, found.withColumnRenamed("_ask", "_p"), [*by, "_p"], "inner")
    else:
        near = nearest_donors(slots, recipients, "_donor", key, "_p", k, by)
    pick = F.floor(uniform(seed, f"{tag}|{target}|pick", "imp_id", key) * F.size("near")) + 1
    run = F.element_at("near", pick.cast("int"))["donor"]
    place = F.floor(uniform(seed, f"{tag}|{target}|tie", "imp_id", key) * run["size"]) + 1
    chosen = near.select(*by, key, run["p"].alias("_p"), place.alias("_place"))
    placed = number_runs(donors, [*by, "_p"], "_donor", F.floor(uniform(seed, f"{tag}|{target}|salt", "imp_id", "_donor") * 64), "_place")
    values = chosen.join(placed.select(*by, "_p", "_place", "_dv"), [*by, "_p", "_place"], "inner").select(*by, key, "_dv")
    out = df.join(values, [*by, key], "left")
    return out.withColumn(target, F.when(F.col(missing), F.col("_dv")).otherwise(F.col(target))).drop("_dv")


def draw_pmm(df: DataFrame, target: str, terms, missing: str, key: str, seed, tag: str, k: int = DONORS) -> DataFrame:
    """Predictive mean matching: donors at the estimate, recipients at the drawn coefficients."""
    fit = linear.fit_lm(df.where(~F.col(missing)), target, terms, by=["imp_id"])
    star = posterior_draw(fit, seed, f"{tag}|{target}")
    d = join_small(df, fit.table.select("imp_id", F.col("beta").alias("_hat")), ["imp_id"])
    d = attach_draw(star, d)
    pred = F.when(F.col(missing), linear.eta(star.terms)).otherwise(linear.eta(fit.terms, "_hat"))
    preds = cut(d.select("imp_id", key, target, missing, pred.alias("_pred")))
    return match_donors(df, target, "_pred", missing, key, seed, tag, k, preds)


def draw_binary(df: DataFrame, target: str, terms, missing: str, key: str, seed, tag: str) -> DataFrame:
    """Logit draw for a 0/1 target."""
    fit = linear.fit_glm(df.where(~F.col(missing)), target, terms, "binomial", by=["imp_id"])
    star = posterior_draw(fit, seed, f"{tag}|{target}")
    d = attach_draw(star, df)
    hit = (uniform(seed, f"{tag}|{target}|u", "imp_id", key) < expit(linear.eta(star.terms))).cast("int")
    value = F.when(F.col(missing), hit.cast(df.schema[target].dataType)).otherwise(F.col(target))
    return d.withColumn(target, value).drop("_beta", "_sd")


def pick_level(levels: Sequence, prob: str, u: Column) -> Column:
    """Level whose cumulative probability first exceeds ``u``."""
    cum = f"aggregate({prob}, array(0D), (a, v) -> concat(a, array(element_at(a, -1) + v)))"
    at = F.expr(f"transform(slice({cum}, 2, {len(levels)}), v -> v)")
    idx = F.size(F.filter(at, lambda v: v <= u)) + 1
    return F.element_at(F.array(*[F.lit(v) for v in levels]), F.least(idx, F.lit(len(levels))))


def draw_multiclass(df: DataFrame, target: str, levels: Sequence, terms, missing: str, key: str, seed, tag: str) -> DataFrame:
    """Multinomial draw for a categorical target."""
    fit = multinomial.fit_multinomial(df.where(~F.col(missing)), target, levels, terms, by=["imp_id"])
    d = fit.pick(df, uniform(seed, f"{tag}|{target}|u", "imp_id", key), "_level")
    return d.withColumn(target, F.when(F.col(missing), F.col("_level")).otherwise(F.col(target))).drop("_level")


def draw_tree(df: DataFrame, target: str, features: Sequence[str], missing: str, key: str, seed, tag: str, kind: str = "forest",
              k: int = DONORS, numTrees: int = 20, maxIter: int = 20, maxDepth: int = 5, stepSize: float = 0.1, minInstancesPerNode: float = 1.0,
              maxBins: int = trees.MAX_BINS, m: int | None = None) -> DataFrame:
    """Tree models of all imputations in one job a level, on keyed bootstraps of observed rows; donors matched on the prediction.

    ``kind`` is ``forest`` or ``boosted``. A numeric target is predicted by its mean; a text target by the likeliest level of the forest,
    or by boosting the level's place in the order. ``m`` is accepted from older calls and says nothing: the table's imputations count.
    """
    observed = df.where(~F.col(missing) & F.col(target).isNotNull())
    groups = sorted((r.imp_id,) for r in df.select("imp_id").distinct().collect())  # one value per imputation
    is_text = df.schema[target].dataType.simpleString() == "string"
    levels = [r[0] for r in observed.select(target).distinct().orderBy(target).collect()] if is_text else []
    place = F.call_function("array_position", F.array(*[F.lit(v) for v in levels]), F.col(target)).cast("double") if is_text else F.col(target).cast("double")
    bins = trees.find_bins(observed, features, place, key, seed, f"{tag}|{target}", maxBins)
    if is_text and kind == "forest":
        y = F.array(*[(F.col(target) == F.lit(v)).cast("double") for v in levels])
    else:
        y = F.array(place)
    rows = observed.select("imp_id", key, y.alias("_y"), bins.columns().alias("_b")).persist()
    name = f"{tag}|{target}"
    if kind == "boosted":
        model = trees.fit_boosted(rows, ["imp_id"], groups, len(features), key, seed, name, maxIter, maxDepth, stepSize, minInstancesPerNode)
    else:
        model = trees.fit_forest(rows, ["imp_id"], groups, max(1, len(levels)), len(features), key, seed, name, numTrees, maxDepth, minInstancesPerNode)
    rows.unpersist()
    out = model.predict(df.withColumn("_b", bins.columns()), ["imp_id"], "_vec", total=kind == "boosted")
    best = F.call_function("array_position", F.col("_vec"), F.array_max("_vec")).cast("double") if is_text and kind == "forest" else F.get("_vec", F.lit(0))
    preds = cut(out.select("imp_id", key, target, missing, best.alias("_pred")))
    return match_donors(df, target, "_pred", missing, key, seed, tag, k, preds, tied=True)


def random_values(df: DataFrame, target: str, key: str, m: int, seed) -> DataFrame:
    """(key, imp_id, target): a random observed value for each of the m copies of every row that lacks one.

    Observed values are numbered by a keyed uniform; only rows without a value look a number up.
    """
    observed = df.where(F.col(target).isNotNull()).select(key, target).withColumn("_u", uniform(seed, f"start|{target}", key))
    numbered = uniform_rank(observed, "_u", key, name="_i").select("_i", target)
    n = observed.count()
    asked = stack_copies(df.where(F.col(target).isNull()).select(key), m)
    asked = asked.withColumn("_i", (F.floor(uniform(seed, f"fill|{target}", "imp_id", key) * F.lit(n)) + 1).cast("bigint"))
    return asked.join(numbered, "_i", "inner").select(key, "imp_id", target)


def fill_missing(df: DataFrame, draws: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Observed values stay; NULLs take the draw; original types; one copy per ``imp_id``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    d = draws.select(key, "imp_id", *[F.col(c).alias(f"_d_{c}") for c in cols])
    out = d.join(df, key, "inner")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_d_{c}").cast(types[c])) for c in cols}).select(*df.columns, "imp_id")


