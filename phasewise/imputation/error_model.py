"""Measurement-error imputation and redraws of implausible values.

A table-level stand-in for learned conditional generators: numeric validated values are the
surrogate minus a modelled residual; categories follow the misclassification table sharpened by
covariates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.functions.keyed import uniform
from phasewise.imputation import draws
from phasewise.models import multinomial
from phasewise.operators.aggregates import error_matrix
from phasewise.operators.columns import Roles
from phasewise.session import cut, join_small


def impute_residual(df: DataFrame, p1: str, p2: str, terms, key: str, seed, tag: str = "resid") -> DataFrame:
    """p2 = p1 - residual, the residual drawn from a linear model; stacked input."""
    d = df.withColumn("_res", F.col(p1) - F.col(p2))
    d = draws.draw_norm(d, "_res", terms, f"_miss_{p2}", key, seed, f"{tag}|{p2}")
    return d.withColumn(p2, F.when(F.col(f"_miss_{p2}"), F.col(p1) - F.col("_res")).otherwise(F.col(p2))).drop("_res")


def impute_category(df: DataFrame, p1: str, p2: str, levels: Sequence, terms, key: str, seed, tag: str = "cat") -> DataFrame:
    """P(p2 | p1, x) is proportional to P(p2 | p1) P(p2 | x) / P(p2); draws from it."""
    observed = df.where(~F.col(f"_miss_{p2}") & (F.col("imp_id") == 1))
    counts = {r["level"]: r["n"] for r in observed.groupBy(F.col(p2).cast("string").alias("level")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    table = error_matrix(observed, p1, p2, "p2_given_p1", smooth=True)
    wide = table.groupBy("given").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("level") == str(v), F.col("prob"))), F.lit(1e-12)) for v in levels
    ]).alias("_q"))
    fit = multinomial.fit_multinomial(observed, p2, levels, terms)
    d = fit.probabilities(df, "_px")
    d = join_small(d.withColumn("given", F.col(p1).cast("string")), wide, ["given"]).drop("given")
    share = F.array(*[F.lit(max(counts.get(str(v), 0), 0.5) / total) for v in levels])
    d = d.withColumn("_w", F.zip_with(F.zip_with(F.coalesce("_q", share), F.col("_px"), lambda a, b: a * b), share, lambda a, b: a / b))
    d = d.withColumn("_tot", F.expr("aggregate(_w, 0D, (a, v) -> a + v)")).withColumn("_prob", F.expr("transform(_w, v -> v / _tot)"))
    value = draws.pick_level(levels, "_prob", uniform(seed, f"{tag}|{p2}|u", "imp_id", key))
    return d.withColumn(p2, F.when(F.col(f"_miss_{p2}"), value).otherwise(F.col(p2))).drop("_q", "_px", "_w", "_tot", "_prob")


def error_model_impute(df: DataFrame, roles: Roles, m: int, seed, numeric_terms: Mapping[str, Column], category_terms: Mapping[str, Column],
                       levels: Mapping[str, Sequence]) -> DataFrame:
    """All pairs of ``roles``; returns m completed copies with ``imp_id``."""
    flags = {f"_miss_{b}": F.col(b).isNull() for _, b in roles.pairs}
    d = draws.stack_copies(df.withColumns(flags), m)
    for p1, p2 in roles.numeric_pairs:
        d = impute_residual(d, p1, p2, {p1: F.col(p1), **numeric_terms}, roles.key, seed)
    for p1, p2 in roles.categorical_pairs:
        d = impute_category(d, p1, p2, levels[p2], category_terms, roles.key, seed)
    return d.drop(*flags)


# Redraws after the first draw, and donors for values still outside.
REDRAWS = 5


def redraw_out_of_range(df: DataFrame, draws_at: Mapping[str, tuple[Column, Column]], limits: Mapping[str, tuple[float, float]], missing: str,
                        key: str, seed, tag: str = "range", redraws: int = REDRAWS) -> DataFrame:
    """Draw all columns of a row together until accepted, at most ``redraws`` times again.

    ``draws_at[col] = (mean, sd)``. A draw is accepted with probability exp(-(sum of violations
    over half-ranges)^2). Values still outside take a donor matched on the generated value.
    """
    from phasewise.functions.keyed import normal

    cols = list(draws_at)
    attempts = []
    for a in range(redraws + 1):
        vals = {c: mu + sd * normal(seed, f"{tag}|{c}|{a}", "imp_id", key) for c, (mu, sd) in draws_at.items()}
        attempts.append(F.struct(*[vals[c].alias(c) for c in cols], uniform(seed, f"{tag}|accept|{a}", "imp_id", key).alias("_u")))
    d = df.withColumn("_tries", F.array(*attempts))

    def violation(e):
        total = None
        for c in cols:
            lo, hi = limits[c]
            v = F.greatest(e[c] - F.lit(float(hi)), F.lit(float(lo)) - e[c], F.lit(0.0)) / F.lit((hi - lo) / 2)
            total = v if total is None else total + v
        return total

    good = F.filter("_tries", lambda e: e["_u"] < F.exp(-F.pow(violation(e), 2)))
    d = d.withColumn("_pick", F.coalesce(F.get(good, F.lit(0)), F.element_at("_tries", -1))).drop("_tries")
    for c in cols:
        lo, hi = limits[c]
        d = d.withColumn(f"_gen_{c}", F.col(f"_pick.{c}"))
        outside = F.col(missing) & ((F.col(f"_gen_{c}") < lo) | (F.col(f"_gen_{c}") > hi))
        d = d.withColumn(f"_out_{c}", outside)
    d = d.drop("_pick")
    for c in cols:
        # Donors are validated rows; recipients are the values still outside.
        # the draws of a row cost many hashes, and the match reads these few rows four times
        donors_only = cut(d.where(~F.col(missing) | F.col(f"_out_{c}")).select("imp_id", key, c, f"_gen_{c}", f"_out_{c}"))
        fixed = draws.match_donors(donors_only, c, f"_gen_{c}", f"_out_{c}", key, seed, tag).where(f"_out_{c}").select("imp_id", key, F.col(c).alias("_fix"))
        d = d.join(fixed, ["imp_id", key], "left")
        value = F.when(F.col(f"_out_{c}"), F.col("_fix")).when(F.col(missing), F.col(f"_gen_{c}")).otherwise(F.col(c))
        d = d.withColumn(c, value).drop("_fix", f"_gen_{c}", f"_out_{c}")
    return d
