"""Order statistics, ranks and running sums that never sort a whole group in one task.

Three tools:

* ``order_stats``   exact values at given ranks, found by narrowing brackets with
  ``percentile_approx`` sketches. Row data is scanned, never shuffled; ties collapse
  in the map-side combine, so a value held by a third of the rows costs one group.
* ``uniform_rank``  exact global rank of a keyed uniform by arithmetic buckets.
* ``running_sums``  prefix sums over any order: range partitions, per-partition totals
  turned into offsets, local windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasewise.session import cut, join_small, settle

# Rows per bracket below which exact value counts are taken.
EXACT_ROWS = 50_000
_GRID = 256
_ACCURACY = 4096
_ALL = "_all"


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, list(by)
    return df.withColumn(_ALL, F.lit(0)), [_ALL]


def order_stats(
    df: DataFrame, value: str, wants: DataFrame, rank_cols: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Exact order statistics.

    ``wants`` has the ``by`` columns and one bigint column of 1-based ranks per name in
    ``rank_cols``. Returns ``by``, ``target`` (index into ``rank_cols``), ``value``,
    ``below`` (rows smaller) and ``tied`` (rows equal). Ranks outside 1..n give no row.
    """
    data, by = _grouped(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), by)
    if _ALL in by:
        wants = wants.withColumn(_ALL, F.lit(0))
    targets = list(enumerate(rank_cols))
    grid = [i / _GRID for i in range(_GRID + 1)]

    first = data.groupBy(*by).agg(
        F.count("*").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", grid, _ACCURACY).alias("_grid"),
    )
    state = first.join(wants, by, "inner")
    start = [F.expr(f"cast({name} as bigint) AS {c}{t}") for t, name in targets for c in ("_r", "_q")]
    start += [F.expr(f"{src} AS {c}{t}") for t, _ in targets for src, c in (("_min", "_lo"), ("_max", "_hi"), ("_n", "_in"), ("_grid", "_g"))]
    state, fits = settle(_narrow(state.select(*by, "_n", *start), len(targets), [*by, "_n"]))
    narrowed = bool(state.where(f"_n > {EXACT_ROWS}").limit(1).toArrow().num_rows)
    state = state.drop("_n")

    while True:
        open_brackets = " OR ".join(f"_in{t} > {EXACT_ROWS}" for t, _ in targets)
        if not state.where(open_brackets).limit(1).toArrow().num_rows:
            break
        joined = data.join(F.broadcast(state) if fits else state, by, "inner")
        aggs = []
        for t, _ in targets:
            lo, hi = F.col(f"_lo{t}"), F.col(f"_hi{t}")
            inside = (F.col("_v") > lo) & (F.col("_v") < hi)
            aggs += [
                (F.first(f"_r{t}") - F.count(F.when(F.col("_v") <= lo, 1))).alias(f"_q{t}"),
                F.count(F.when(inside, 1)).alias(f"_in{t}"),
                F.percentile_approx(F.when(inside, F.col("_v")), grid, _ACCURACY).alias(f"_g{t}"),
            ] + [F.first(f"_{p}{t}").alias(f"_{p}{t}") for p in ("r", "lo", "hi")]
        state, fits = settle(_narrow(joined.groupBy(*by).agg(*aggs), len(targets), by))

    pairs = F.expr("array(" + ", ".join(f"named_struct('target', {t}, 'rank', _r{t})" for t, _ in targets) + ")")
    visible = [b for b in by if b != _ALL]
    if not narrowed:
        # Small groups: one count per value serves every rank.
        counts = data.groupBy(*by, "_v").agg(F.count("*").alias("tied"))
        w = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_through", F.sum("tied").over(w))
        ranks = state.select(*by, pairs.alias("_pairs"))
        below = F.col("_through") - F.col("tied")
        hit = F.filter("_pairs", lambda e: (e["rank"] > below) & (e["rank"] <= F.col("_through")))
        return counts.join(F.broadcast(ranks) if fits else ranks, by, "inner").select(
            *visible, F.explode(hit).alias("_h"), F.col("_v").alias("value"), below.alias("below"), "tied"
        ).select(*visible, "_h.target", "_h.rank", "value", "below", "tied")

    # Exact counts: everything under a bracket is one group, inside it one group per value.
    joined = data.join(F.broadcast(state) if fits else state, by, "inner")
    marks = F.array(*[
        F.when(F.col("_v") < F.col(f"_lo{t}"), F.struct(F.lit(t).alias("t"), F.lit(None).cast(data.schema["_v"].dataType).alias("v")))
        .when(F.col("_v") <= F.col(f"_hi{t}"), F.struct(F.lit(t).alias("t"), F.col("_v").alias("v")))
        for t, _ in targets
    ])
    counts = (
        joined.select(*by, F.explode(F.array_compact(marks)).alias("m"))
        .groupBy(*by, F.col("m.t").alias("target"), F.col("m.v").alias("value"))
        .agg(F.count("*").alias("tied"))
    )
    w = Window.partitionBy(*by, "target").orderBy(F.col("value").asc_nulls_first())
    through = F.sum("tied").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranks = state.select(*by, F.explode(pairs).alias("w")).select(*by, "w.target", "w.rank")
    out = (
        counts.withColumn("through", through)
        .join(F.broadcast(ranks) if fits else ranks, [*by, "target"], "inner")
        .withColumn("below", F.col("through") - F.col("tied"))
        .where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("through")) & F.col("value").isNotNull())
    )
    return out.select(*visible, "target", "rank", "value", "below", "tied")


def _narrow(state: DataFrame, n_targets: int, keep: Sequence[str]) -> DataFrame:
    """Move each bracket to the grid cells around its rank, one cell of slack each side.

    ``_q`` is the wanted rank among the ``_in`` rows strictly inside the bracket; the grid is
    a sketch of those rows. Its error (1/4096) is a sixteenth of a cell, so the slack always
    covers it, and rows strictly inside the new bracket are at most 4.5 cells. Rows tied with
    an end of the bracket do not count: they stay one group however many they are.
    """
    cut_lo, cut_hi, moved = [], [], []
    for t in range(n_targets):
        wide = f"(_in{t} > {EXACT_ROWS} AND _lo{t} < _hi{t})"
        cell = f"cast(floor(greatest(least((_q{t} - 1) / greatest(_in{t} - 1, 1), 1D), 0D) * {_GRID}) as int)"
        cut_lo.append(F.expr(f"""CASE WHEN {wide} AND _q{t} > _in{t} THEN _hi{t}
            WHEN {wide} AND _q{t} > 0 AND {cell} > 1 THEN element_at(_g{t}, greatest({cell}, 1)) ELSE _lo{t} END AS _nlo{t}"""))
        cut_hi.append(F.expr(f"""CASE WHEN {wide} AND _q{t} <= 0 THEN _lo{t}
            WHEN {wide} AND _q{t} <= _in{t} AND {cell} < {_GRID - 2} THEN element_at(_g{t}, least({cell} + 3, {_GRID + 1}))
            ELSE _hi{t} END AS _nhi{t}"""))
        cut_hi.append(F.expr(f"CASE WHEN {wide} THEN cast(_in{t} * {4.5 / _GRID}D as bigint) ELSE _in{t} END AS _nin{t}"))
        moved += [
            F.expr(f"CASE WHEN _nlo{t} = _nhi{t} THEN 0L ELSE _nin{t} END AS _in{t}"),
            F.expr(f"_nlo{t} AS _lo{t}"), F.expr(f"_nhi{t} AS _hi{t}"), f"_r{t}",
        ]
    return state.select("*", *cut_lo, *cut_hi).select(*keep, *moved)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles with linear interpolation at (n-1)p; NULLs skipped. Returns ``by``, ``prob``, ``value``."""
    probs = [float(p) for p in probs]
    n = F.count(value)
    cols = [
        F.expr(f"cast({fn}((_total - 1) * {p!r}D) as bigint) + 1 AS {c}{i}")
        for i, p in enumerate(probs) for fn, c in (("floor", "a"), ("ceil", "b"))
    ]
    wants = df.groupBy(*by).agg(n.alias("_total")).select(*by, *cols)
    names = [f"{s}{i}" for i in range(len(probs)) for s in "ab"]
    stats = order_stats(df, value, wants, names, by)
    total = df.groupBy(*by).agg(n.alias("_total"))
    pair = (
        stats.withColumn("_i", F.floor(F.col("target") / 2))
        .groupBy(*by, "_i")
        .agg(
            F.max(F.when(F.col("target") % 2 == 0, F.col("value"))).alias("_a"),
            F.max(F.when(F.col("target") % 2 == 1, F.col("value"))).alias("_b"),
        )
    )
    table = F.element_at(F.array(*[F.lit(p) for p in probs]), (F.col("_i") + 1).cast("int"))
    joined = pair.join(total, list(by), "inner") if by else pair.join(F.broadcast(total))
    h = (F.col("_total") - 1) * table
    return joined.select(
        *by,
        table.alias("prob"),
        (F.col("_a") + (h - F.floor(h)) * (F.col("_b") - F.col("_a"))).cast("double").alias("value"),
    )


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """The same for one ungrouped column, as plain numbers (a few scalars on the driver)."""
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, value, probs).collect()}
    return [got[float(p)] for p in probs]


def rank_cuts(
    df: DataFrame, value: str, key: str, wants: DataFrame, rank_cols: Sequence[str], by: Sequence[str] = ()
) -> tuple[DataFrame, bool]:
    """Row at each wanted rank in the order (value, key), as ``_cv{t}``/``_ck{t}`` per group.

    ``key`` must be unique and numeric. A key is only searched for when several rows tie
    on the wanted value.
    """
    by = list(by)
    stats, small = settle(order_stats(df, value, wants, rank_cols, by))
    stats = stats.withColumn("_need", F.col("rank") - F.col("below"))
    open_ties = stats.where(F.col("_need") < F.col("tied"))
    cuts = stats.select(*by, "target", F.col("value").alias("_cv"), "_need", "tied")
    if open_ties.limit(1).toArrow().num_rows:
        ties = open_ties.select(*by, F.col("target").alias("_t"), F.col("value").alias("_cv"), "_need")
        base = df.select(*by, F.col(value).alias("_cv"), F.col(key).alias("_k"))
        on = by + ["_cv"]
        rows = base.join(F.broadcast(ties) if small else ties, on, "inner")
        keys = order_stats(rows, "_k", ties.select(*by, "_t", "_need"), ["_need"], by + ["_t"])
        cuts = cuts.join(
            keys.select(*by, F.col("_t").alias("target"), F.col("value").alias("_ck")), by + ["target"], "left"
        )
    else:
        cuts = cuts.withColumn("_ck", F.lit(None).cast(df.schema[key].dataType))
    # Without an open tie every row holding the value is inside: no key bound is needed.
    if len(rank_cols) == 1:
        return settle(cuts.select(*by, F.col("_cv").alias("_cv0"), F.col("_ck").alias("_ck0")))
    wide, by_all = _grouped(cuts, by)
    wide = wide.groupBy(*by_all).agg(*[
        F.max(F.when(F.col("target") == t, F.col(c))).alias(f"{c}{t}")
        for t in range(len(rank_cols)) for c in ("_cv", "_ck")
    ])
    return settle(wide)


def attach_cuts(df: DataFrame, cuts: tuple[DataFrame, bool], by: Sequence[str] = ()) -> DataFrame:
    table, small = cuts
    if by:
        return df.join(F.broadcast(table) if small else table, list(by), "left")
    row = table.first()
    for f in table.schema.fields:
        if f.name != _ALL:
            df = df.withColumn(f.name, F.lit(None if row is None else row[f.name]).cast(f.dataType))
    return df


def at_or_below(value: Column, key: Column, t: int) -> Column:
    """Row is at or before cut ``t``. Several ranks share one tie group only through the key."""
    cv, ck = F.col(f"_cv{t}"), F.col(f"_ck{t}")
    return F.coalesce((value < cv) | ((value == cv) & (ck.isNull() | (key <= ck))), F.lit(False))


def lowest(df: DataFrame, value: str, key: str, quota: DataFrame, n_col: str, by: Sequence[str] = (), name: str = "chosen") -> DataFrame:
    """Flag the ``n_col`` lowest rows by (value, key) in each group; no group is ever sorted whole."""
    cuts = rank_cuts(df, value, key, quota, [n_col], by)
    out = attach_cuts(df, cuts, by).withColumn(name, at_or_below(F.col(value), F.col(key), 0))
    return out.drop("_cv0", "_ck0")


def uniform_rank(df: DataFrame, u: str, key: str, by: Sequence[str] = (), name: str = "rank", per_bucket: int = 100_000) -> DataFrame:
    """1-based rank of a uniform column within each group, ties by key.

    Uniform values spread evenly over arithmetic buckets, so the window below never sees
    more than about ``per_bucket`` rows, however large the group is.
    """
    data, by_all = _grouped(df, by)
    sizes = data.groupBy(*by_all).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_bucket)).alias("_nb"))
    data = join_small(data, sizes, by_all).withColumn("_b", F.floor(F.col(u) * F.col("_nb")))
    counts = data.groupBy(*by_all, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by_all).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by_all, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*by_all, "_b").orderBy(u, key))
    return (
        join_small(data, offsets, [*by_all, "_b"], "inner")
        .withColumn(name, (F.col("_off") + local).cast("bigint"))
        .drop("_nb", "_b", "_off", _ALL)
    )


def range_parts(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Range-partition by (``by``, ``order``), note the partition number, and fix it by a checkpoint."""
    return cut(
        df.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("_part", F.spark_partition_id())
    )


def running_sums(
    df: DataFrame, order: Sequence[str], sums: dict[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Add prefix sums ``{new: column}`` in ``order`` within each group (inclusive).

    ``order`` must be unique within a group; aggregate equal values first.
    """
    by = list(by)
    ranged = range_parts(df, order, by)
    totals = ranged.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    prior = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_small(ranged, offsets, [*by, "_part"], "inner")
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"_o_{n}") + F.sum(c).over(here))
    return out.drop("_part", *[f"_o_{n}" for n in sums])


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with ``n``, ``through`` (rows <= value) per group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running_sums(counts, [value], {"through": "n"}, by)
