"""Hyper-parameter search tables."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasewise.functions.keyed import uniform
from phasewise.imputation import draws
from phasewise.operators.columns import Roles
from phasewise.operators.evaluation import energy_distances
from phasewise.operators.joins import pareto_front
from phasewise.operators.resampling import fold_assign
from phasewise.session import cut, join_small, settle


def rank_to_utopia(trials: DataFrame, m1: str, m2: str, key: str, k: int = 5) -> DataFrame:
    """Best k front trials by distance to (0, 0) after scaling both losses by the front's range."""
    front = pareto_front(trials, m1, m2)
    r = front.agg(F.min(m1).alias("_a0"), F.max(m1).alias("_a1"), F.min(m2).alias("_b0"), F.max(m2).alias("_b1"))
    d = front.join(F.broadcast(r))

    def scaled(c, lo, hi):
        span = F.col(hi) - F.col(lo)
        return F.when(span > 0, (F.col(c) - F.col(lo)) / span).otherwise(0.0)

    a, b = scaled(m1, "_a0", "_a1"), scaled(m2, "_b0", "_b1")
    return d.withColumn("distance", F.sqrt(a * a + b * b)).drop("_a0", "_a1", "_b0", "_b1").orderBy("distance", key).limit(k)


# Pruning share, warm-up and the score of a failed trial.
PRUNE_SHARE = 0.75
PRUNE_WARMUP = 10
FAILED = 1e9


def search_space(trials: DataFrame, key: str, grid: Mapping[str, tuple], seed) -> DataFrame:
    """Random parameters per trial. ``grid[name]`` is one of

    ("choice", [values]), ("int", lo, hi), ("float", lo, hi), ("log", lo, hi),
    ("pow2", lo_exp, hi_exp), ("step", lo, hi, step).
    """
    out = {}
    for name, (kind, *a) in grid.items():
        u = uniform(seed, name, key)
        if kind == "choice":
            out[name] = F.element_at(F.array(*[F.lit(v) for v in a[0]]), (F.floor(u * len(a[0])) + 1).cast("int"))
        elif kind == "int":
            out[name] = (F.lit(a[0]) + F.floor(u * (a[1] - a[0] + 1))).cast("int")
        elif kind == "float":
            out[name] = F.lit(float(a[0])) + u * F.lit(float(a[1] - a[0]))
        elif kind == "log":
            lo, hi = math.log(a[0]), math.log(a[1])
            out[name] = F.exp(F.lit(lo) + u * F.lit(hi - lo))
        elif kind == "pow2":
            out[name] = F.pow(F.lit(2.0), F.lit(a[0]) + F.floor(u * (a[1] - a[0] + 1))).cast("int")
        elif kind == "step":
            n = int(round((a[1] - a[0]) / a[2])) + 1
            out[name] = F.lit(float(a[0])) + F.floor(u * n) * F.lit(float(a[2]))
        else:
            raise ValueError(kind)
    return trials.select(key).withColumns(out)


def masked_cv_score(
    df: DataFrame, roles: Roles, imputer: Callable[[DataFrame], DataFrame], folds: int, m: int, seed,
    trial: int = 0,
) -> DataFrame:
    """Score an imputer by masking validated columns of one fold at a time on complete rows.

    All folds and imputations form one stacked table whose ``imp_id`` numbers (fold, imputation),
    so the imputer runs once. Returns (trial, fold, mse, error) averaged over imputations.
    """
    complete = df.dropna(subset=[c for p in roles.pairs for c in p])
    d = fold_assign(complete, roles.key, folds, seed)
    truth = d.select(roles.key, "fold", *[F.col(c).alias(f"_t_{c}") for c in roles.phase2])
    stacked = draws.stack_copies(d, folds * m).withColumn("_held", F.col("fold") == F.floor((F.col("imp_id") - 1) / m))
    stacked = stacked.withColumns({c: F.when(~F.col("_held"), F.col(c)) for c in roles.phase2})
    stacked = stacked.withColumns({f"_miss_{c}": F.col("_held") for c in roles.phase2})
    num, cat = [b for _, b in roles.numeric_pairs], [b for _, b in roles.categorical_pairs]
    try:
        done = imputer(stacked).where("_held").select(roles.key, "imp_id", *roles.phase2)
        j = done.join(truth, roles.key, "inner")
        mse = [f"avg(pow(`{c}` - `_t_{c}`, 2)) / var_samp(`_t_{c}`)" for c in num]
        err = [f"avg(cast(cast(`{c}` as string) != cast(`_t_{c}` as string) as double))" for c in cat]
        per = j.groupBy("fold", "imp_id").agg(
            F.expr("(" + " + ".join(mse or ["0D"]) + f") / {max(len(num), 1)}").alias("mse"),
            F.expr("(" + " + ".join(err or ["0D"]) + f") / {max(len(cat), 1)}").alias("error"))
        scores = per.groupBy("fold").agg(F.avg("mse").alias("mse"), F.avg("error").alias("error"))
        scores = settle(scores)[0]
    except (PythonException, np.linalg.LinAlgError) as e:
        if "LinAlgError" not in f"{type(e).__name__} {e}":
            raise  # a lost executor or a bug is no bad trial
        # a numerical failure scores the worst value
        scores = df.sparkSession.range(folds).select(F.col("id").alias("fold"), F.lit(FAILED).alias("mse"), F.lit(FAILED).alias("error"))
    return scores.select(F.lit(trial).alias("trial"), F.col("fold").cast("bigint").alias("fold"), "mse", "error")


def masked_cv_scores(
    df: DataFrame, roles: Roles, imputers: Mapping[int, Callable[[DataFrame], DataFrame]], folds: int, m: int, seed,
) -> DataFrame:
    """All trials in one job: (trial, fold, mse, error, energy, loss), averaged over the m imputations.

    ``imputers`` holds one imputer for each trial's configuration. Complete rows are dealt to folds; an imputer gets
    its trial's stacked table, in which ``imp_id`` numbers (fold, imputation) and the fold's validated columns are masked and
    flagged ``_miss_<column>``. ``mse`` and ``error`` are weighted by the share of numeric and categorical columns, ``energy`` is the
    distance of held and imputed rows of one imputation. Trials whose imputer fails belong to ``masked_cv_score``.
    """
    complete = df.dropna(subset=[c for p in roles.pairs for c in p])
    d = cut(fold_assign(complete, roles.key, folds, seed).withColumn("fold", F.col("fold").cast("bigint")))
    stacked = draws.stack_copies(d, folds * m).withColumn("_held", F.col("fold") == F.floor((F.col("imp_id") - 1) / m))
    stacked = stacked.withColumns({f"_miss_{c}": F.col("_held") for c in roles.phase2})
    stacked = stacked.withColumns({c: F.when(~F.col("_held"), F.col(c)) for c in roles.phase2})
    done = None
    for trial, imputer in imputers.items():
        part = imputer(stacked).where("_held").select(F.lit(int(trial)).cast("bigint").alias("trial"), "fold", "imp_id", roles.key, *roles.phase2)
        done = part if done is None else done.unionByName(part)
    done = cut(done)
    num, cat = [b for _, b in roles.numeric_pairs], [b for _, b in roles.categorical_pairs]
    truth = d.select(roles.key, *[F.col(c).alias(f"_t_{c}") for c in roles.phase2])
    j = done.join(truth, roles.key, "inner")
    by = ["trial", "fold", "imp_id"]
    mse = [F.avg(F.pow(F.col(c) - F.col(f"_t_{c}"), 2)) / F.nullif(F.var_samp(f"_t_{c}"), F.lit(0.0)) for c in num]
    err = [F.avg((F.col(c).cast("string") != F.col(f"_t_{c}").cast("string")).cast("double")) for c in cat]
    total = len(num) + len(cat)
    per = j.groupBy(*by).agg((sum(mse, F.lit(0.0)) / total).alias("mse"), (sum(err, F.lit(0.0)) / total).alias("error"))
    held = j.select(*by, *[F.col(f"_t_{c}").alias(c) for c in roles.phase2])
    energy = energy_distances(held, done, by, num, cat)
    scores = per.join(energy, by).groupBy("trial", "fold").agg(*[F.avg(c).alias(c) for c in ("mse", "error", "energy")])
    return scores.withColumn("loss", F.col("mse") + F.col("error") + F.col("energy"))


def _above(seen: list[float], v: float) -> bool:
    """Whether ``v``, a member of the sorted list, exceeds its interpolated PRUNE_SHARE percentile.

    That holds exactly when more members lie below ``v`` than stand before the percentile's place.
    """
    return bool(seen) and bisect.bisect_left(seen, v) > math.floor(PRUNE_SHARE * (len(seen) - 1))


def prune_trials(scores: DataFrame, trial: str, fold: str, m1: str, m2: str, n_trials: int, by: Sequence[str] = ()) -> DataFrame:
    """Flag a trial at the fold where both its losses exceed the 75th percentile of that fold so far.

    The history of a fold holds the trials that reached it, the current one included, and counts for
    the warm-up of max(10, a quarter of ``n_trials``). A pruned trial reaches no later fold; nothing
    is pruned at the last one. The rule is sequential, so one task walks the trials of one study
    (``by``) with two sorted lists a fold; studies run side by side.
    """
    warm = max(PRUNE_WARMUP, n_trials // 4)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([fold, trial], ignore_index=True)
        last, gone = pdf[fold].max(), set()
        reached, pruned = [], []
        for f, part in pdf.groupby(fold, sort=True):
            first, second, n = [], [], 0
            for t, a, b in zip(part[trial], part[m1], part[m2]):
                here = t not in gone
                hit = False
                if here and f != last:
                    n += 1
                    for seen, v in ((first, a), (second, b)):
                        if not pd.isna(v):
                            bisect.insort(seen, v)
                    hit = n >= warm and not pd.isna(a) and not pd.isna(b) and _above(first, a) and _above(second, b)
                if hit:
                    gone.add(t)
                reached.append(here)
                pruned.append(hit)
        return pdf.assign(reached=reached, pruned=pruned)

    fields = [*scores.schema.fields, T.StructField("reached", T.BooleanType()), T.StructField("pruned", T.BooleanType())]
    return scores.where(F.col(fold).isNotNull()).groupBy(*by).applyInPandas(walk, T.StructType(fields))


def choose_config(trials: DataFrame, m1: str, m2: str, params: Sequence[str], integers: Sequence[str] = ()) -> DataFrame:
    """Per-parameter median over the Pareto front; integer parameters are rounded."""
    front = pareto_front(trials, m1, m2)
    med = front.agg(*[F.median(p).alias(p) for p in params])
    return med.withColumns({p: F.round(p).cast("int") for p in integers}) if integers else med


def coefficient_bias_score(est: DataFrame, truth: DataFrame, weights: Mapping[str, float] | None = None, by: Sequence[str] = ("trial",)) -> DataFrame:
    """Weighted |coefficient - truth| / (|truth| + mean |truth|) per trial."""
    scale = truth.agg(F.avg(F.abs(F.col("truth"))).alias("_scale"))
    t = truth.join(F.broadcast(scale))
    d = join_small(est, t, ["term"], "inner")
    w = F.lit(1.0)
    for term, v in (weights or {}).items():
        w = F.when(F.col("term") == term, F.lit(float(v))).otherwise(w)
    score = F.abs(F.col("estimate") - F.col("truth")) / (F.abs(F.col("truth")) + F.col("_scale"))
    return d.withColumn("_w", w).groupBy(*by).agg((F.sum(F.col("_w") * score) / F.sum("_w")).alias("score"))


def choose_rounds(df: DataFrame, target: str, features: Sequence[str], key: str, seed, folds: int = 5, repeats: int = 20, rounds: int = 100, **params) -> int:
    """Boosting rounds with the lowest held-out loss: cross-validated, repeated, median taken."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    d = VectorAssembler(inputCols=list(features), outputCol="_features").transform(df.dropna(subset=[target, *features])).select(key, target, "_features")
    best = []
    for rep in range(repeats):
        f = fold_assign(d, key, folds, f"{seed}-{rep}").persist()
        losses = np.zeros(rounds)
        for k in range(folds):
            model = GBTRegressor(featuresCol="_features", labelCol=target, maxIter=rounds, seed=rep, **params).fit(f.where(F.col("fold") != k))
            losses += np.array(model.evaluateEachIteration(f.where(F.col("fold") == k), "squared"))
        f.unpersist()
        best.append(int(np.argmin(losses)) + 1)
    return int(np.median(best))
