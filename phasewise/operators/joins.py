"""Joins of cohorts, event tables, look-ups and donors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasewise.operators.order import range_parts, running_sums
from phasewise.session import join_small


def spine_join(spine: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join one-row-per-subject tables; the key is text on every side."""
    out = spine.withColumn(key, F.col(key).cast("string"))
    for part in parts:
        out = out.join(part.withColumn(key, F.col(key).cast("string")), key, "left")
    return out


def exclude_subjects(df: DataFrame, key: str, column: str) -> DataFrame:
    """Drop every row of a subject with one NULL in ``column``."""
    bad = df.where(F.col(column).isNull()).select(key).distinct()
    return join_small(df, bad, [key], "left_anti")


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str], drop_null: str | None = None) -> DataFrame:
    """Earliest row per key. Spark limits each map task to one row per key before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.where(F.col(drop_null).isNotNull()) if drop_null else df
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def window_nearest(
    events: DataFrame, facts: DataFrame, key: str, event_id: str, target: str, anchor: str,
    at: str, value: str, fact_id: str, lo: float, hi: float, name: str,
) -> DataFrame:
    """Fact whose time lies in [target+lo, target+hi], nearest to ``anchor``.

    Facts join on (subject, time bucket) with buckets as wide as the window, so one subject
    with very many facts is spread over its buckets. Ties: earlier time, then smaller id.
    """
    width = F.lit(float(hi - lo))
    f = facts.select(
        F.col(key), F.col(at).alias("_at"), F.col(value).alias("_val"), F.col(fact_id).alias("_fid"),
        F.floor(F.col(at) / width).alias("_bucket"),
    ).where(F.col("_at").isNotNull())
    first = F.floor((F.col(target) + F.lit(float(lo))) / width)
    last = F.floor((F.col(target) + F.lit(float(hi))) / width)
    e = events.select(key, event_id, target, anchor).withColumn(
        "_bucket", F.explode_outer(F.when(F.col(target).isNotNull(), F.sequence(first, last)))
    )
    hit = (
        e.join(f, [key, "_bucket"], "inner")
        .where((F.col("_at") >= F.col(target) + F.lit(float(lo))) & (F.col("_at") <= F.col(target) + F.lit(float(hi))))
        .groupBy(event_id)
        .agg(F.min_by("_val", F.struct(F.abs(F.col("_at") - F.col(anchor)), F.col("_at"), F.col("_fid"))).alias(name))
    )
    return events.join(hit, event_id, "left")


def alias_join(facts: DataFrame, column: str, alias: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """Canonical test names. ``alias`` has columns ``alias`` and ``canonical``."""
    squeezed = F.trim(F.regexp_replace(F.lower(F.col(column)), r"\s+", " "))
    out = join_small(facts.withColumn("alias", squeezed), alias.select("alias", "canonical"), ["alias"])
    out = out.withColumn(column, F.coalesce("canonical", "alias")).drop("alias", "canonical")
    return out.where(F.col(column).isin(*wanted)) if wanted is not None else out


def attach_group_stats(df: DataFrame, key: Sequence[str] | str, aggs: dict) -> DataFrame:
    """Group statistics on every row. Aggregated first, so a hot group is never gathered."""
    keys = [key] if isinstance(key, str) else list(key)
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_small(df, stats, keys, "inner")


def attach_weights(df: DataFrame, key: Sequence[str] | str, table: DataFrame) -> DataFrame:
    return join_small(df, table, [key] if isinstance(key, str) else list(key), "left")


def attach_truth(est: DataFrame, truth: DataFrame, on: Sequence[str] = ("term",)) -> DataFrame:
    return join_small(est, truth, list(on), "inner")


def dedupe_join(a: DataFrame, b: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep one row per key of ``b`` (first in ``order``), then left join."""
    return a.join(first_per_key(b, key, order), key, "left")


def align_rows(a: DataFrame, b: DataFrame, key: str | Sequence[str], how: str = "inner") -> DataFrame:
    return a.join(b, key, how)


def remaining_rows(df: DataFrame, chosen: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return df.join(chosen, key, "left_anti")


def pareto_front(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows no other row dominates on two losses, without comparing pairs.

    One row per distinct first loss is enough; it survives if its smallest second loss is
    below every smaller first loss's. The running minimum goes over range partitions.
    """
    best = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(first).agg(F.min(second).alias("_b"))
    ranged = range_parts(best, [first])
    totals = ranged.groupBy("_part").agg(F.min("_b").alias("_m"))
    prior = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.min("_m").over(prior).alias("_o"))
    here = Window.partitionBy("_part").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    front = (
        join_small(ranged, offsets, ["_part"], "inner")
        .withColumn("_p", F.least(F.col("_o"), F.min("_b").over(here)))
        .where(F.col("_p").isNull() | (F.col("_b") < F.col("_p")))
        .select(first, F.col("_b").alias(second))
    )
    return df.join(front, [first, second], "left_semi")


def number_runs(df: DataFrame, run: Sequence[str], key: str, salt: Column, name: str) -> DataFrame:
    """Number the rows of equal ``run`` values from 1, in order of (salt, key).

    Rows are numbered inside (run, salt) and moved up by the counts of smaller salts, so a run of
    any length is spread over its salts (a few dozen).
    """
    run = list(run)
    d = df.withColumn("_salt", salt)
    counts = d.groupBy(*run, "_salt").agg(F.count("*").alias("_c"))
    below = Window.partitionBy(*run).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*run, "_salt", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*run, "_salt").orderBy(key))
    return d.withColumn("_rn", inside).join(offsets, [*run, "_salt"], "inner").withColumn(name, F.col("_o") + F.col("_rn")).drop("_salt", "_rn", "_o")


def nearest_donors(
    donors: DataFrame, recipients: DataFrame, donor_key: str, recipient_key: str, pred: str, k: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per recipient an array ``near`` of the k donors nearest in predicted value.

    Entries are (distance, donor) in order; ties go to the smaller donor key. Exact for any
    size: distinct donor predictions get ranks by a distributed prefix sum, and every gap
    between ranks gets the k ranks below and above it. Only donors (the validated share) are
    multiplied; recipients meet their gap once and sort at most 2k candidates in the row. A gap
    with very many recipients is a skewed join key on one side only, which AQE splits.
    At most k donors per distinct prediction can ever be chosen, so equal ones stay bounded.
    """
    by = list(by)
    d = donors.select(*by, F.col(pred).alias("_p"), F.col(donor_key).alias("_d")).where(F.col("_p").isNotNull())
    top = Window.partitionBy(*by, "_p").orderBy("_d")
    d = d.withColumn("_rn", F.row_number().over(top)).where(F.col("_rn") <= k)
    d = d.groupBy(*by, "_p").agg(F.array_sort(F.collect_list("_d")).alias("_donors"))
    # Donor predictions and recipients on one line; donors come first where both agree.
    key_type = recipients.schema[recipient_key].dataType
    line = d.select(*by, "_p", F.lit(0).alias("_kind"), F.lit(None).cast(key_type).alias("_id"), "_donors", F.lit(1).alias("_isd")).unionByName(
        recipients.where(F.col(pred).isNotNull()).select(
            *by, F.col(pred).alias("_p"), F.lit(1).alias("_kind"), F.col(recipient_key).alias("_id"),
            F.lit(None).cast(d.schema["_donors"].dataType).alias("_donors"), F.lit(0).alias("_isd")))
    ranked = running_sums(line, ["_p", "_kind", "_id"], {"_pos": "_isd"}, by)
    gaps = (
        ranked.where(F.col("_isd") == 1)
        .select(*by, F.struct(F.col("_p").alias("p"), F.col("_donors").alias("ds")).alias("_c"),
                F.explode(F.sequence(F.col("_pos") - k, F.col("_pos") + (k - 1))).alias("_pos"))
        .groupBy(*by, "_pos")
        .agg(F.collect_list("_c").alias("_cands"))
    )
    # sort_array compares the entries itself; array_sort would call a comparison expression for each pair
    near = F.expr(f"""slice(sort_array(flatten(transform(_cands, c -> transform(c.ds,
        d -> named_struct('distance', abs(c.p - _p), 'donor', d))))), 1, {k})""")
    asks = ranked.where(F.col("_kind") == 1).select(*by, F.col("_id").alias(recipient_key), "_p", "_pos")
    return asks.join(gaps, [*by, "_pos"], "inner").select(*by, recipient_key, near.alias("near"))


def knn_donors(
    donors: DataFrame, recipients: DataFrame, donor_key: str, recipient_key: str, pred: str, k: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """The same as rows: ``by``, ``recipient_key``, ``donor_key``, ``distance``, ``rank``."""
    near = nearest_donors(donors, recipients, donor_key, recipient_key, pred, k, by)
    rows = near.select(*by, recipient_key, F.posexplode("near").alias("_i", "_n"))
    return rows.select(*by, recipient_key, F.col("_n.donor").alias(donor_key), F.col("_n.distance").alias("distance"), (F.col("_i") + 1).alias("rank"))
