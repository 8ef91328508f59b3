"""Chained equations on a stacked table: m chains advance side by side."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.imputation import draws, weighted_likelihood
from phasewise.models import linear
from phasewise.operators.aggregates import safe_corr
from phasewise.operators.columns import level_codes
from phasewise.session import columns_used, cut, drop_cut, join_small

# Sweeps, correlation threshold and its step when a fit is singular.
SWEEPS = 25
MIN_CORRELATION = 0.1
CORRELATION_STEP = 0.05


@dataclass
class Target:
    """How one column is imputed. ``terms`` refer to current column values."""

    method: str
    terms: Mapping[str, Column]
    levels: Sequence | None = None
    options: Mapping = field(default_factory=dict)


def _norm(d, name, t, key, seed, tag):
    return draws.draw_norm(d, name, t.terms, f"_miss_{name}", key, seed, tag, **t.options)


def _pmm(d, name, t, key, seed, tag):
    return draws.draw_pmm(d, name, t.terms, f"_miss_{name}", key, seed, tag, **t.options)


def _binary(d, name, t, key, seed, tag):
    return draws.draw_binary(d, name, t.terms, f"_miss_{name}", key, seed, tag)


def _multiclass(d, name, t, key, seed, tag):
    return draws.draw_multiclass(d, name, t.levels, t.terms, f"_miss_{name}", key, seed, tag)


def _forest(d, name, t, key, seed, tag):
    return draws.draw_tree(d, name, list(t.terms), f"_miss_{name}", key, seed, tag, "forest", **t.options)


def _boosted(d, name, t, key, seed, tag):
    return draws.draw_tree(d, name, list(t.terms), f"_miss_{name}", key, seed, tag, "boosted", **t.options)


def _weighted_likelihood(d, name, t, key, seed, tag):
    return weighted_likelihood.draw_in_chain(d, name, t.terms, f"_miss_{name}", key, seed, tag, **t.options)


# Methods by name; add an entry to plug in another one.
METHODS: dict[str, Callable] = {
    "norm": _norm, "pmm": _pmm, "binary": _binary, "multiclass": _multiclass, "forest": _forest, "boosted": _boosted,
    "weighted_likelihood": _weighted_likelihood,
}


class Chains:
    """m chains over one copy of the rows.

    ``base`` holds each row once: key, observed targets and the columns that some term reads. ``drawn`` holds,
    for rows with a missing target, one array of m values for each missing target. They meet by the key, row
    by row and not copy by copy; only ``drawn`` is written again after a step, and its last version deleted. Columns
    that no term reads wait in the caller's table.
    """

    def __init__(self, df: DataFrame, targets: Mapping[str, Target], key: str, m: int, seed):
        self.targets, self.key, self.m = targets, key, m
        self.reads = {t: _columns_read(df, spec) for t, spec in targets.items()}
        every = [c for c in df.columns if c == key or c in targets or any(c in r for r in self.reads.values())]
        self.base = cut(df.select(every))
        self.kinds = {t: df.schema[t].dataType.simpleString() for t in targets}
        self.drawn = self._start(seed)

    def _flagged(self) -> DataFrame:
        return self.base.withColumns({f"_miss_{t}": F.col(t).isNull() for t in self.targets})

    def _start(self, seed) -> DataFrame:
        """A random observed value for every missing one."""
        some = None
        for t in self.targets:
            some = F.col(f"_miss_{t}") if some is None else some | F.col(f"_miss_{t}")
        out = self._flagged().where(some).select(self.key)
        for t in self.targets:
            filled = draws.random_values(self.base, t, self.key, self.m, seed)
            out = out.join(self._arrays(filled, t), self.key, "left")
        return cut(out)

    def _arrays(self, rows: DataFrame, t: str) -> DataFrame:
        """(key, array of m values) from (key, imp_id, value) rows."""
        each = F.sort_array(F.collect_list(F.struct("imp_id", F.col(t).cast(self.kinds[t]).alias("v"))))  # m entries
        return rows.groupBy(self.key).agg(F.transform(each, lambda e: e["v"]).alias(f"_d_{t}"))

    def stacked(self, names: Sequence[str] | None = None) -> DataFrame:
        """The chains side by side, with ``names`` of the base's columns and every target they hold."""
        keep = self.base.columns if names is None else [c for c in self.base.columns if c in (self.key, *names)]
        held = [c for c in keep if c in self.targets]
        rows = self._flagged().select(*keep, *[f"_miss_{t}" for t in held])
        rows = rows.join(self.drawn.select(self.key, *[f"_d_{t}" for t in held]), self.key, "left")
        rows = draws.stack_copies(rows, self.m)
        return rows.withColumns({t: F.coalesce(t, F.get(f"_d_{t}", F.col("imp_id") - 1)) for t in held}).drop(*[f"_d_{t}" for t in held])

    def step(self, t: str, seed, tag: str) -> None:
        """Draw one target anew in all chains."""
        spec = self.targets[t]
        view = self.stacked([t, *self.reads[t]])
        done = METHODS[spec.method](view, t, spec, self.key, seed, tag).where(f"_miss_{t}").select(self.key, "imp_id", t)
        others = [c for c in self.drawn.columns if c != f"_d_{t}"]
        last, self.drawn = self.drawn, cut(self.drawn.select(others).join(self._arrays(done, t), self.key, "left"))
        drop_cut(last)

    def completed(self, df: DataFrame) -> DataFrame:
        """m copies of ``df``, missing targets filled by the chains."""
        rows = draws.stack_copies(df.join(self.drawn, self.key, "left"), self.m)
        filled = {t: F.coalesce(t, F.get(f"_d_{t}", F.col("imp_id") - 1)) for t in self.targets}
        return rows.withColumns(filled).select(*df.columns, "imp_id")


def _columns_read(df: DataFrame, spec: Target) -> list[str]:
    if not isinstance(spec.terms, Mapping) or spec.method in ("forest", "boosted"):
        return list(spec.terms)
    return columns_used(df, *spec.terms.values())


def chained_equations(df: DataFrame, targets: Mapping[str, Target], key: str, m: int = 5, maxit: int = SWEEPS, seed=1) -> DataFrame:
    """m completed copies after ``maxit`` sweeps over the targets.

    A step costs one pass over ``base`` and one version of the drawn arrays: what it writes grows with the missing
    cells times m, not with the table's width. Rows with a null key cannot be told apart and are not allowed.
    """
    chains = Chains(df, targets, key, m, seed)
    for sweep in range(1, maxit + 1):
        for name in targets:
            chains.step(name, seed, f"sweep{sweep}")
    return chains.completed(df)


def impute_fixed(df: DataFrame, targets: Mapping[str, Target], key: str, m: int = 5, seed=1) -> DataFrame:
    """One pass in the given order, each target from its stated predictors; normal draws by default.

    Predictors that are themselves targets must come earlier in the order.
    """
    flags = {f"_miss_{t}": F.col(t).isNull() for t in targets}
    d = draws.stack_copies(df.withColumns(flags), m)
    for name, t in targets.items():
        d = METHODS[t.method](d, name, t, key, seed, "once")
    return d.drop(*flags)


def default_targets(df: DataFrame, cols: Sequence[str], predictors: Mapping[str, Sequence[str]] | None = None, options: Mapping[str, Mapping] | None = None) -> dict[str, Target]:
    """Targets for every column of ``cols`` with NULLs, method by type.

    Numeric: donor matching. Two levels: logit. More levels: multinomial. Predictors default to
    all other columns; text predictors enter as 0/1 columns. Level lists are small by nature.
    """
    text = [c for c in cols if df.schema[c].dataType.simpleString() == "string"]
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).first()
    levels = {c: [r[0] for r in level_codes(df, c).orderBy("code").select(c).collect()] for c in text}

    def terms(target):
        out = {}
        for c in (predictors or {}).get(target, [c for c in cols if c != target]):
            if c in levels:
                out.update({f"{c}_{v}": (F.col(c) == F.lit(v)).cast("double") for v in levels[c][1:]})
            else:
                out[c] = F.col(c)
        return out

    targets = {}
    for c in cols:
        if not counts[c]:
            continue
        if c in levels:
            targets[c] = Target("multiclass", terms(c), levels[c])
        else:
            values = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().limit(3).collect()]
            method = "binary" if set(values) == {0, 1} else "pmm"
            targets[c] = Target(method, terms(c), None, (options or {}).get(c, {}))
    return targets


def select_predictors(df: DataFrame, cols: Sequence[str], mincor: float = MIN_CORRELATION, forced: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Predictor table (target, predictor, correlation, used).

    A column is used if its correlation with the target, or with the target's missingness,
    reaches ``mincor`` in absolute value, or if it is forced. One pass for all pairs; text
    columns enter by level code.
    """
    d = df
    for c in cols:
        if d.schema[c].dataType.simpleString() == "string":
            codes = level_codes(df, c, "_code")
            d = join_small(d, codes, [c]).withColumn(c, F.col("_code").cast("double")).drop("_code")
    d = d.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)],
                 *[F.col(c).isNull().cast("double").alias(f"r{i}") for i, c in enumerate(cols)])
    aggs, parts = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                continue
            aggs += [F.expr(f"{safe_corr(f'v{i}', f'v{j}')} AS c{i}_{j}"), F.expr(f"{safe_corr(f'r{i}', f'v{j}')} AS m{i}_{j}")]
            must = b in (forced or {}).get(a, ())
            parts.append(f"named_struct('target', '{a}', 'predictor', '{b}', 'forced', {str(must).lower()}, "
                         f"'correlation', greatest(abs(nvl(c{i}_{j}, 0D)), abs(nvl(m{i}_{j}, 0D))))")
    long = d.agg(*aggs).select(F.explode(F.expr("array(" + ", ".join(parts) + ")")).alias("e")).select("e.*")
    return long.withColumn("used", F.col("forced") | (F.col("correlation") >= F.lit(float(mincor)))).drop("forced")


def retry_collinear(df: DataFrame, target: str, cols: Sequence[str], mincor: float = MIN_CORRELATION, step: float = CORRELATION_STEP) -> tuple[list[str], float]:
    """Raise ``mincor`` until the linear fit of ``target`` is not singular; returns predictors and threshold."""
    table = select_predictors(df, [target, *cols], 0.0).where(F.col("target") == target).collect()
    strength = {r["predictor"]: r["correlation"] for r in table}
    while True:
        used = [c for c in cols if strength[c] >= mincor]
        if not used or mincor > 1:
            return used, mincor
        if not linear.fit_lm(df, target, used).table.first()["singular"]:
            return used, mincor
        mincor = round(mincor + step, 10)
