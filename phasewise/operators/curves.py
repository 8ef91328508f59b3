"""The empirical distribution as a table: every distinct value is a knot, however many there are.

A monotone cubic is local: a knot's slope depends on its two neighbours, found by their position, and a value
depends on the two knots around it. Nothing but the three knots at either end passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasewise.functions.scalar import norm_ppf
from phasewise.operators.order import range_parts, running_sums
from phasewise.operators.transforms import EPSILON, pchip_slopes
from phasewise.session import cut


@dataclass
class EcdfCurve:
    """``knots``: pos, x, u (mid-rank share) and d (slope), written to the shared folder."""

    knots: DataFrame
    size: int


def fit_ecdf_curve(df: DataFrame, value: str) -> EcdfCurve:
    """Knots of all distinct values of a column; nulls are skipped. One value alone has slope zero."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    ranks = cut(running_sums(counts.withColumn("one", F.lit(1)), ["x"], {"through": "n", "pos": "one"}))
    size, total = ranks.agg(F.count("*"), F.max("through")).first()
    k = ranks.select("pos", "x", ((F.col("through") - 0.5 * F.col("n")) / F.lit(float(total or 1))).alias("u"))
    if size < 2:
        return EcdfCurve(cut(k.withColumn("d", F.lit(0.0))), size)
    ends = k.where((F.col("pos") <= 3) | (F.col("pos") > size - 3)).orderBy("pos").collect()  # at most six
    low, high = ([(r["x"], r["u"]) for r in part] for part in (ends[:3], ends[-3:]))
    first, last = pchip_slopes(*np.array(low).T)[0], pchip_slopes(*np.array(high).T)[-1]
    before = k.select((F.col("pos") + 1).alias("pos"), F.col("x").alias("xl"), F.col("u").alias("ul"))
    after = k.select((F.col("pos") - 1).alias("pos"), F.col("x").alias("xr"), F.col("u").alias("ur"))
    d = k.join(before, "pos", "left").join(after, "pos", "left")
    d = d.withColumns({"hl": F.col("x") - F.col("xl"), "hr": F.col("xr") - F.col("x")})
    d = d.withColumns({"sl": (F.col("u") - F.col("ul")) / F.col("hl"), "sr": (F.col("ur") - F.col("u")) / F.col("hr")})
    # shares rise from knot to knot, so both slopes are positive and their weighted harmonic mean is defined
    w1, w2 = 2 * F.col("hr") + F.col("hl"), F.col("hr") + 2 * F.col("hl")
    inside = (w1 + w2) / (w1 / F.col("sl") + w2 / F.col("sr"))
    slope = F.when(F.col("pos") == 1, F.lit(float(first))).when(F.col("pos") == size, F.lit(float(last))).otherwise(inside)
    return EcdfCurve(cut(d.select("pos", "x", "u", slope.alias("d"))), size)


def ecdf_share(curve: EcdfCurve, df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Add the curve's share at ``value``: exact at knots, the monotone cubic between, the end knots' beyond; null for null.

    Distinct values are merged into the knots in one order: each range part knows its last knot, and the last one of the
    parts before it, so a value finds the knot at or below it wherever it lies.
    """
    if not curve.size:
        return df.withColumn(name, F.lit(None).cast("double"))
    v = F.col(value).cast("double")
    knot = F.struct("pos", "x", "u", "d")
    asked = df.where(v.isNotNull()).select(v.alias("v")).distinct()
    both = curve.knots.select(F.col("x").alias("v"), knot.alias("k")).unionByName(asked, allowMissingColumns=True)
    parts = range_parts(both.withColumn("_asked", F.col("k").isNull().cast("int")), ["v"])
    here = Window.partitionBy("_part").orderBy("v", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    tops = parts.groupBy("_part").agg(F.max_by("k", F.when(F.col("k").isNotNull(), F.col("v"))).alias("top"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carried = tops.select("_part", F.last("top", ignorenulls=True).over(before).alias("carried"))
    found = parts.withColumn("below", F.last("k", ignorenulls=True).over(here)).where("_asked = 1").join(F.broadcast(carried), "_part")
    found = found.select("v", F.coalesce("below", "carried").alias("a"))
    right = curve.knots.select((F.col("pos") - 1).alias("at"), knot.alias("b"))
    found = found.withColumn("at", F.coalesce(F.col("a.pos"), F.lit(0))).join(right, "at", "left")
    h, t = F.col("b.x") - F.col("a.x"), (F.col("v") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    cubic = (
        (1 + 2 * t) * (1 - t) * (1 - t) * F.col("a.u") + t * (1 - t) * (1 - t) * h * F.col("a.d")
        + t * t * (3 - 2 * t) * F.col("b.u") + t * t * (t - 1) * h * F.col("b.d")
    )
    share = F.when(F.col("a").isNull(), F.col("b.u")).when(F.col("b").isNull() | (F.col("v") == F.col("a.x")), F.col("a.u")).otherwise(cubic)
    looked = cut(found.select(F.col("v").alias("_v"), share.alias(name)))
    return df.withColumn("_v", v).join(looked, "_v", "left").drop("_v")


def ecdf_score(curve: EcdfCurve, df: DataFrame, value: str, name: str = "score", clip: float = EPSILON) -> DataFrame:
    """Normal score of the share, kept inside (clip, 1 - clip)."""
    d = ecdf_share(curve, df, value, "_share")
    return d.withColumn(name, norm_ppf(F.least(F.greatest(F.col("_share"), F.lit(clip)), F.lit(1 - clip)))).drop("_share")
