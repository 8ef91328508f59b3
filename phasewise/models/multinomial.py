"""Multinomial logit by Newton steps over a table of groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasewise.models.linear import as_terms, safe_inverse, stack_column, unsettled
from phasewise.session import join_small, per_row_numpy

MAX_STEPS = 40
TOLERANCE = 1e-9


@dataclass
class MultinomialFit:
    """``table``: by, ``beta`` (levels-1 x p, flat), ``cov``, ``n``, ``moved``, ``converged``. The first level is the reference."""

    levels: list
    terms: dict[str, Column]
    by: list[str]
    table: DataFrame

    def _scores(self, beta: str = "_beta") -> list[str]:
        p = len(self.terms)
        return ["0D"] + [" + ".join(f"{beta}[{k * p + i}] * _x[{i}]" for i in range(p)) for k in range(len(self.levels) - 1)]

    def probabilities(self, df: DataFrame, name: str = "_prob") -> DataFrame:
        """Add an array of class probabilities in level order."""
        if self.by:
            d = join_small(df, self.table.select(*self.by, F.col("beta").alias("_beta")), self.by)
        else:
            d = df.withColumn("_beta", F.array(*[F.lit(float(v)) for v in self.table.first()["beta"]]))
        d = d.withColumn("_x", F.array(*self.terms.values()))
        d = d.withColumn("_s", F.expr("array(" + ", ".join(self._scores()) + ")"))
        d = d.withColumn("_top", F.array_max("_s")).withColumn("_s", F.expr("transform(_s, v -> exp(v - _top))"))
        d = d.withColumn("_tot", F.expr("aggregate(_s, 0D, (a, v) -> a + v)"))
        return d.withColumn(name, F.expr("transform(_s, v -> v / _tot)")).drop("_beta", "_x", "_s", "_top", "_tot")

    def pick(self, df: DataFrame, u: Column, name: str) -> DataFrame:
        """Add the level whose cumulative probability first exceeds ``u``, by plain columns, which compile."""
        if self.by:
            d = join_small(df, self.table.select(*self.by, F.col("beta").alias("_beta")), self.by)
        else:
            d = df.withColumn("_beta", F.array(*[F.lit(float(v)) for v in self.table.first()["beta"]]))
        n, p = len(self.levels), len(self.terms)
        d = d.withColumns({f"_x{i}": c for i, c in enumerate(self.terms.values())})
        d = d.withColumns({f"_s{k}": F.expr(" + ".join(f"_beta[{(k - 1) * p + i}] * _x{i}" for i in range(p)) if k else "0D") for k in range(n)})
        d = d.withColumn("_top", F.greatest(*[f"_s{k}" for k in range(n)]) if n > 1 else F.col("_s0"))
        d = d.withColumns({f"_e{k}": F.exp(F.col(f"_s{k}") - F.col("_top")) for k in range(n)})
        d = d.withColumn("_tot", F.expr(" + ".join(f"_e{k}" for k in range(n)))).withColumn("_u", u)
        d = d.withColumn("_c0", F.expr("_e0 / _tot"))
        for k in range(1, n):
            d = d.withColumn(f"_c{k}", F.expr(f"_c{k - 1} + _e{k} / _tot"))
        place = F.expr(" + ".join(f"CASE WHEN _c{k} <= _u THEN 1 ELSE 0 END" for k in range(n))) + 1
        d = d.withColumn(name, F.element_at(self.level_array(), F.least(place, F.lit(n))))
        return d.drop("_beta", "_top", "_tot", "_u", *[f"_x{i}" for i in range(p)], *[f"_{c}{k}" for c in "sec" for k in range(n)])

    def level_array(self) -> Column:
        return F.array(*[F.lit(v) for v in self.levels])


def _sums(by: Sequence[str], xs: Sequence[str], m: int, blocks: Sequence[tuple[int, int]], pairs: Sequence[tuple[int, int]]):
    """A task's rows to one row a batch and group: gradient, blocks of the information, likelihood."""

    def add(batches):
        for batch in batches:
            n, columns = batch.num_rows, dict(zip(batch.schema.names, batch.columns))
            if not n:
                continue
            k, w = (columns[c].to_numpy(zero_copy_only=False) for c in ("_k", "_w"))
            x = np.column_stack([columns[c].to_numpy(zero_copy_only=False) for c in xs])
            beta = columns["_beta"].flatten().to_numpy(zero_copy_only=False).reshape(n, m, len(xs))
            with np.errstate(all="ignore"):
                e = np.concatenate([np.zeros((n, 1)), np.einsum("ncp,np->nc", beta, x)], axis=1)
                e = np.exp(e - e.max(axis=1, keepdims=True))
                prob = e / e.sum(axis=1, keepdims=True)
                hit, q = prob[np.arange(n), k], prob[:, 1:]
                grad = w[:, None, None] * ((k[:, None] == np.arange(1, m + 1)) - q)[:, :, None] * x[:, None, :]
                curve = np.column_stack([q[:, c] * (1 - q[:, c]) if c == d else -q[:, c] * q[:, d] for c, d in blocks]) * w[:, None]
                curve = curve[:, :, None] * np.column_stack([x[:, i] * x[:, j] for i, j in pairs])[:, None, :]
                all_ = np.column_stack([grad.reshape(n, -1), curve.reshape(n, -1), w * np.log(np.maximum(hit, 1e-300))])
            if by:  # rows of a group side by side, then one sum a group
                group = pa.Table.from_batches([batch]).select(list(by)).to_pandas().groupby(list(by), sort=False).ngroup().to_numpy()
                order = np.argsort(group, kind="stable")
                first = np.flatnonzero(np.diff(group[order], prepend=-1))
            else:
                order, first = np.arange(n), np.zeros(1, np.int64)
            total = np.add.reduceat(all_[order], first, axis=0)
            head = batch.select([*by, "_beta", "_before"]).take(pa.array(order[first]))
            count = pa.array(np.diff(first, append=n).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*head.columns, count, *[pa.array(t) for t in total.T]],
                                             names=[*by, "_beta", "_before", "_c", *[f"_t{i}" for i in range(total.shape[1])]])

    return add


def fit_multinomial(df: DataFrame, y: str, levels: Sequence, terms, weight: str | None = None, by: Sequence[str] = ()) -> MultinomialFit:
    """``levels`` in order; the first is the reference. ``table`` has a row a group: beta, cov, n, ``moved``, ``converged``.

    The state is a table: every step joins it to the rows, tasks add up the class-by-class blocks of the information batch
    by batch, their sums are summed as columns, and one row a group is solved, on the driver only while groups are few. The
    number of sums grows with the square of levels and of terms. Rows of other levels or with nulls take no part; a group
    without rows is absent, an ungrouped fit of no rows stays at zero and is not converged.
    """
    terms = as_terms(terms)
    by = list(by)
    p, m = len(terms), len(levels) - 1
    dim = m * p
    codes = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(levels))):
        codes = F.when(F.col(y) == F.lit(v), F.lit(i)).otherwise(codes)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    xs = [f"x{i}" for i in range(p)]
    frame = df.select(*by, codes.alias("_k"), w.alias("_w"), *[c.alias(x) for x, c in zip(xs, terms.values())]).dropna().persist()
    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in by] + [
        T.StructField("beta", arr), T.StructField("cov", arr), T.StructField("n", T.LongType()), T.StructField("likelihood", T.DoubleType()),
        T.StructField("moved", T.DoubleType()), T.StructField("converged", T.BooleanType()),
    ])
    blocks = [(c, d) for c in range(m) for d in range(c, m)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    packed = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in by], T.StructField("_beta", arr), T.StructField("_before", T.DoubleType()),
                           T.StructField("_c", T.LongType()), *[T.StructField(f"_t{i}", T.DoubleType()) for i in range(m * p + len(blocks) * len(pairs) + 1)]])

    def rows(pdf: pd.DataFrame, beta, cov, likelihood, moved, converged) -> pd.DataFrame:
        return pdf[by].assign(beta=list(beta), cov=list(cov.reshape(len(pdf), dim * dim)), n=pdf["_n"].astype("int64"), likelihood=likelihood, moved=moved, converged=converged)

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        g = len(pdf)
        return rows(pdf, np.zeros((g, dim)), np.zeros((g, dim, dim)), np.full(g, -np.inf), np.full(g, np.inf), np.zeros(g, bool))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        g = len(pdf)
        sums = stack_column(pdf["_H"]).reshape(g, len(blocks), len(pairs))
        info = np.zeros((g, m, p, m, p))
        for a, (c, d) in enumerate(blocks):
            for b, (i, j) in enumerate(pairs):
                for u, v in {(c, d), (d, c)}:
                    info[:, u, i, v, j] = info[:, u, j, v, i] = sums[:, a, b]
        inv = safe_inverse(info.reshape(g, dim, dim))[0] if g else np.zeros((0, dim, dim))
        delta = np.einsum("gij,gj->gi", inv, stack_column(pdf["_G"]).reshape(g, dim))
        size = np.abs(delta).max(axis=1, initial=0.0)
        delta *= np.minimum(1.0, 5.0 / np.maximum(size, 1e-300))[:, None]
        now = pdf["_L"].to_numpy(float)
        # Under separation coefficients run off while the likelihood has settled.
        settled = np.abs(now - pdf["_prior"].to_numpy(float)) <= 1e-10 * np.abs(now)
        moved = np.abs(delta).max(axis=1, initial=0.0)
        return rows(pdf, stack_column(pdf["_b"]).reshape(g, dim) + delta, inv, now, moved, settled | (moved < TOLERANCE))

    sizes = frame.groupBy(*by).agg(F.count("*").alias("_n"))
    table, small, local = per_row_numpy(sizes, start, schema)
    worst, empty = np.inf, not by and table.first()["n"] == 0
    for _ in range(0 if empty else MAX_STEPS):
        if by:
            state = table.select(*by, F.col("beta").alias("_beta"), F.col("likelihood").alias("_before"))
            d = frame.join(F.broadcast(state) if small else state, by)
        else:
            now = table.first()
            d = frame.withColumns({"_beta": F.array(*[F.lit(float(v)) for v in now["beta"]]), "_before": F.lit(float(now["likelihood"]))})
        parts = d.select(*by, "_beta", "_before", "_k", "_w", *xs).mapInArrow(_sums(by, xs, m, blocks, pairs), packed)
        at = [f"sum(_t{i})" for i in range(len(packed) - len(by) - 3)]
        sums = parts.groupBy(*by).agg(
            F.expr("array(" + ", ".join(at[:dim]) + ")").alias("_G"), F.expr("array(" + ", ".join(at[dim:-1]) + ")").alias("_H"),
            F.expr(at[-1]).alias("_L"), F.sum("_c").alias("_n"), F.first("_beta").alias("_b"), F.first("_before").alias("_prior"),
        )
        table, small, local = per_row_numpy(sums, step, schema)
        open_ = table.where("NOT converged").agg(F.max("moved")).first()[0] if local is None else local.loc[~local["converged"], "moved"].max()
        worst = 0.0 if open_ is None or open_ != open_ else float(open_)
        if worst == 0.0:
            break
    else:
        if not empty:
            unsettled(f"multinomial fit of {y}", worst)
    frame.unpersist()
    return MultinomialFit(list(levels), terms, by, table.drop("likelihood"))


def predict_class(fit: MultinomialFit, df: DataFrame, name: str = "pred") -> DataFrame:
    """Most likely class (ties: first level) and its 1-based position."""
    d = fit.probabilities(df)
    pos = F.array_position("_prob", F.array_max("_prob"))
    return d.withColumn(f"{name}_index", pos.cast("int")).withColumn(name, F.element_at(fit.level_array(), F.col(f"{name}_index"))).drop("_prob")
