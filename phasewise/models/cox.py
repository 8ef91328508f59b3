"""Proportional hazards with Efron ties over distributed risk sets.

Rows are range-partitioned by (group, time) and sorted once, and fixed by a checkpoint as blocks
of packed numbers. Every Newton step is two narrow passes over the blocks: per-partition totals become
the risk-set sums entering each partition from later times, then each partition walks its own times with
numpy. Times on a partition boundary may straddle partitions (a hot tie is spread by a hash), so their sums are
kept apart in the first pass and their terms are computed from the totals. What reaches the
driver is three small vectors per (group, partition), never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phasewise.models.linear import Fit, as_terms, coef_schema, safe_inverse, sandwich, unpack, unsettled
from phasewise.operators.order import range_parts
from phasewise.session import cut, drop_cut, join_small, local_frame

MAX_STEPS = 30
TOLERANCE = 1e-9


class _Sums:
    """Layout of one sum vector: S0, S1(p), S2(p(p+1)/2)."""

    def __init__(self, p: int):
        self.p, self.q = p, p * (p + 1) // 2
        self.width = 1 + self.p + self.q

    def of_rows(self, r: np.ndarray, x: np.ndarray) -> np.ndarray:
        i, j = np.triu_indices(self.p)
        return np.hstack([r[:, None], r[:, None] * x, r[:, None] * x[:, i] * x[:, j]])


def _tie_scalars(s0, e0, d):
    """Per event time: sums over l < d of log, a, f a, a^2, f a^2, f^2 a^2; f = l/d, a = 1/(S0 - f E0)."""
    out = np.zeros((6, len(s0)))
    one = d == 1
    a = 1.0 / s0[one]
    out[0, one], out[1, one], out[3, one] = np.log(s0[one]), a, a * a
    for k in np.flatnonzero(d > 1):
        for lo in range(0, int(d[k]), 1_000_000):
            f = np.arange(lo, min(lo + 1_000_000, int(d[k]))) / d[k]
            v = s0[k] - f * e0[k]
            a = 1.0 / v
            out[:, k] += [np.log(v).sum(), a.sum(), (f * a).sum(), (a * a).sum(), (f * a * a).sum(), (f * f * a * a).sum()]
    return out


def _event_terms(lay: _Sums, beta, s, e, d, dw, xs):
    """Log-likelihood, score and information summed over event times (rows with d > 0)."""
    p = lay.p
    on = d > 0
    s, e, d, dw, xs = s[on], e[on], d[on], dw[on], xs[on]
    if not len(d):
        return 0.0, np.zeros(p), np.zeros((p, p))
    log, a, fa, a2, fa2, f2a2 = _tie_scalars(s[:, 0], e[:, 0], d)
    w = dw / d
    s1, e1 = s[:, 1:1 + p], e[:, 1:1 + p]
    score = (xs - w[:, None] * (s1 * a[:, None] - e1 * fa[:, None])).sum(axis=0)
    s2 = unpack(((w * a)[:, None] * s[:, 1 + p:] - (w * fa)[:, None] * e[:, 1 + p:]).sum(axis=0)[None, :], p)[0]
    cross = np.einsum("k,ki,kj->ij", w * fa2, s1, e1)
    info = s2 - (np.einsum("k,ki,kj->ij", w * a2, s1, s1) - cross - cross.T + np.einsum("k,ki,kj->ij", w * f2a2, e1, e1))
    return float((xs @ beta).sum() - (w * log).sum()), score, info


def _hazard_terms(lay: _Sums, s, e, d, dw):
    """Per event time: hazard step H, vector step B, and the correction for rows failing there."""
    p, k = lay.p, len(d)
    h, hc = np.zeros(k), np.zeros(k)
    b, bc, xbar = np.zeros((k, p)), np.zeros((k, p)), np.zeros((k, p))
    on = d > 0
    if on.any():
        _, a, fa, a2, fa2, f2a2 = _tie_scalars(s[on, 0], e[on, 0], d[on])
        w = dw[on] / d[on]
        s1, e1 = s[on, 1:1 + p], e[on, 1:1 + p]
        h[on], hc[on] = w * a, w * fa
        b[on] = w[:, None] * (s1 * a2[:, None] - e1 * fa2[:, None])
        bc[on] = w[:, None] * (s1 * fa2[:, None] - e1 * f2a2[:, None])
        xbar[on] = (s1 * a[:, None] - e1 * fa[:, None]) / d[on][:, None]
    return h, b, hc, bc, xbar


def _runs(pdf: pd.DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Start positions of runs of equal values."""
    change = np.zeros(len(pdf), bool)
    change[0] = True
    for c in cols:
        v = pdf[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _whole_times(batches: Iterator[pd.DataFrame], gp: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Re-cut Arrow batches so that no (group, partition, time) is split between two."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if held:
            last = held[-1].iloc[-1]
            same = all(pdf[c].iloc[-1] == last[c] for c in [*gp, "_t"])
            held.append(pdf)
            if same:
                continue
            pdf = pd.concat(held, ignore_index=True)
        start = _runs(pdf, [*gp, "_t"])[-1]
        if start:
            yield pdf.iloc[:start]
        held = [pdf.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


class CoxData:
    """Rows prepared for risk-set passes."""

    def __init__(self, df: DataFrame, time: str, event: str, terms, weight: str | None, by: Sequence[str], carry: Sequence[str] = ()):
        self.terms = as_terms(terms, intercept=False)
        self.p = len(self.terms)
        self.lay = _Sums(self.p)
        self.by = list(by) or ["_all"]
        self.named_by = list(by)
        xs = [f"x{i}" for i in range(self.p)]
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        src = df if by else df.withColumn("_all", F.lit(0))
        rows = src.select(
            *self.by, F.col(time).cast("double").alias("_t"), F.col(event).cast("int").alias("_d"), w.alias("_w"),
            *[c.alias(x) for x, c in zip(xs, self.terms.values())], *[F.col(c).alias(f"_c_{c}") for c in carry],
        ).dropna(subset=["_t", "_d", "_w", *xs])
        rows = rows.withColumn("_salt", F.xxhash64("_t", *xs, *[f"_c_{c}" for c in carry]))
        self.kept = range_parts(rows, ["_t", "_salt"], self.by)
        means = self.kept.agg(*[F.avg(x).alias(x) for x in xs]).first()
        self.centre = np.array([means[x] or 0.0 for x in xs])
        ranged = self.kept.drop("_salt").withColumns({x: F.col(x) - F.lit(float(m)) for x, m in zip(xs, self.centre)})
        edges = ranged.groupBy(*self.by, "_part").agg(F.min("_t").alias("_t0"), F.max("_t").alias("_t1"))
        self.rows = join_small(ranged, edges, [*self.by, "_part"], "inner").withColumn(
            "_edge", F.when((F.col("_t") == F.col("_t0")) | (F.col("_t") == F.col("_t1")), F.col("_t"))
        )
        self.sorted = self.rows.sortWithinPartitions(*self.by, "_part", F.desc("_t"))
        self.carry = list(carry)
        self.packed = self._pack()

    def _pack(self) -> DataFrame:
        """The sorted numbers t, d, w, x.. of about one Arrow batch of rows a block, no time of a run in two; steps read these."""
        gp, numbers = [*self.by, "_part"], ["_t", "_d", "_w", *[f"x{i}" for i in range(self.p)]]
        head = [*gp, "_t0", "_t1"]

        def walk(batches):
            for pdf in _whole_times(batches, gp):
                starts = list(_runs(pdf, gp)) + [len(pdf)]
                runs = [pdf.iloc[a:b] for a, b in zip(starts[:-1], starts[1:])]
                yield pd.DataFrame({**{c: [g[c].iloc[0] for g in runs] for c in head},
                                    "_block": [np.ascontiguousarray(g[numbers].to_numpy(dtype=float).T).tobytes() for g in runs]})

        schema = T.StructType([self.rows.schema[c] for c in head] + [T.StructField("_block", T.BinaryType())])
        return cut(self.sorted.select(*head, *numbers).mapInPandas(walk, schema))

    def drop(self) -> None:
        """Delete the files of rows and blocks."""
        drop_cut(self.packed)
        drop_cut(self.kept)

    def _walk(self, each, finish, schema: T.StructType) -> pd.DataFrame:
        """``each(state, key, t0, t1, columns)`` for the blocks of every task in order, then its rows ``finish(state)``."""
        gp, width = [*self.by, "_part"], 3 + self.p
        names = schema.fieldNames()

        def walk(batches):
            state = {}
            for batch in batches:
                heads = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*gp, "_t0", "_t1"]]
                blocks = batch.column(batch.schema.get_field_index("_block"))
                for at, head in enumerate(zip(*heads)):
                    columns = np.frombuffer(blocks[at].as_buffer(), float).reshape(width, -1)
                    each(state, head[:-2], *head[-2:], columns)
            found = finish(state)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), kind.type) for v, kind in zip(zip(*found), to_arrow_schema(schema))], names)

        return self.packed.mapInArrow(walk, schema).toPandas()

    def totals(self, betas: dict) -> pd.DataFrame:
        """First pass: sums per (group, partition, boundary time or interior)."""
        p, lay = self.p, self.lay
        shared = self.packed.sparkSession.sparkContext.broadcast(betas)

        def each(state, key, t0, t1, columns):
            t, ev, w, x = columns[0], columns[1], columns[2], columns[3:].T
            r = w * np.exp(x @ shared.value[key[:-1]])
            sums = np.hstack([lay.of_rows(r, x), (ev * w)[:, None] * x])
            ends = (t == t0) | (t == t1)
            for edge, on in [(None, ~ends), *[(v, t == v) for v in {t0, t1}]]:
                if on.any():
                    s, e = sums[on], ev[on]
                    now = np.concatenate([s[:, :lay.width].sum(axis=0), e @ s[:, :lay.width], [e.sum(), e @ w[on]], s[:, lay.width:].sum(axis=0), [on.sum()]])
                    state[(*key, edge)] = state.get((*key, edge), 0.0) + now
                    state.setdefault("first", {})[key] = t0

        def finish(state):
            first, k = state.pop("first", {}), lay.width
            return [(*at, first[at[:-1]], v[:k].tolist(), v[k:2 * k].tolist(), int(v[2 * k]), v[2 * k + 1], v[2 * k + 2:2 * k + 2 + p].tolist(), int(v[-1]))
                    for at, v in state.items()]

        numbers = T.ArrayType(T.DoubleType())
        schema = T.StructType([self.rows.schema[c] for c in [*self.by, "_part"]] + [
            T.StructField(n, kind) for n, kind in [("_edge", T.DoubleType()), ("_t0", T.DoubleType()), ("s", numbers), ("e", numbers), ("d", T.LongType()),
                                                   ("dw", T.DoubleType()), ("xs", numbers), ("n", T.LongType())]])
        return self._walk(each, finish, schema)

    def blocks(self, totals: pd.DataFrame):
        """Order boundary times and interiors by time; return edge sums and offsets per interior."""
        edges, offsets = {}, {}
        for key, g in totals.groupby(self.by, sort=False):
            key = key if isinstance(key, tuple) else (key,)
            inner = g["_edge"].isna().to_numpy()
            pos = np.where(inner, g["_t0"], g["_edge"]).astype(float)
            s, e = np.stack(g["s"].to_numpy()).astype(float), np.stack(g["e"].to_numpy()).astype(float)
            xs = np.stack(g["xs"].to_numpy()).astype(float)
            d, dw = g["d"].to_numpy(dtype=float), g["dw"].to_numpy(dtype=float)
            part = g["_part"].to_numpy()
            # Same boundary time in several partitions: one block. An interior sorts after its first time.
            times, inv = np.unique(np.column_stack([pos, inner]), axis=0, return_inverse=True)
            m = len(times)
            inv = inv.ravel()

            def fold(v):
                out = np.zeros((m,) + v.shape[1:])
                np.add.at(out, inv, v)
                return out

            bs = fold(s)
            after = np.vstack([np.cumsum(bs[::-1], axis=0)[::-1], np.zeros((1, bs.shape[1]))])
            is_in = times[:, 1] == 1
            edges[key] = {"t": times[~is_in, 0], "s": after[:-1][~is_in], "e": fold(e)[~is_in], "d": fold(d)[~is_in],
                          "dw": fold(dw)[~is_in], "xs": fold(xs)[~is_in]}
            for k in np.flatnonzero(inner):
                offsets[(*key, part[k])] = after[inv[k] + 1]
        return edges, offsets

    def interior_pass(self, betas: dict, offsets: dict, hazards: bool = False) -> pd.DataFrame:
        """Second pass over rows strictly between boundary times; one small row per run."""
        lay, p = self.lay, self.p
        shared = self.packed.sparkSession.sparkContext.broadcast((betas, offsets))

        def each(state, key, t0, t1, columns):
            betas, offsets = shared.value
            inside = (columns[0] != t0) & (columns[0] != t1)
            if not inside.any():
                return
            t, ev, w, x = columns[0, inside], columns[1, inside], columns[2, inside], columns[3:, inside].T
            run, acc = state.get(key) or (offsets[key], 0.0)
            beta = betas[key[:-1]]
            s, e, d, dw, xs, _ = _sums_at_times(lay, t, ev, w, x, beta, run)
            if hazards:
                h, bv, _, _, _ = _hazard_terms(lay, s, e, d, dw)
                acc = acc + np.concatenate([[h.sum()], bv.sum(axis=0)])
            else:
                ll, u, info = _event_terms(lay, beta, s, e, d, dw, xs)
                acc = acc + np.concatenate([[ll], u, info.ravel()])
            state[key] = s[-1], acc

        schema = T.StructType([self.rows.schema[c] for c in [*self.by, "_part"]] + [T.StructField("acc", T.ArrayType(T.DoubleType()))])
        return self._walk(each, lambda state: [(*key, acc.tolist()) for key, (_, acc) in state.items()], schema)


def _at_times(lay: _Sums, g: pd.DataFrame, xs_cols, beta, run):
    """Risk-set and event sums at each distinct time of rows in descending time order."""
    w, ev, t = g["_w"].to_numpy(dtype=float), g["_d"].to_numpy(dtype=float), g["_t"].to_numpy()
    return _sums_at_times(lay, t, ev, w, g[xs_cols].to_numpy(dtype=float), beta, run)


def _sums_at_times(lay: _Sums, t, ev, w, x, beta, run):
    """The same for columns."""
    r = w * np.exp(x @ beta)
    rows = lay.of_rows(r, x)
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    s = run + np.cumsum(np.add.reduceat(rows, starts, axis=0), axis=0)
    e = np.add.reduceat(rows * ev[:, None], starts, axis=0)
    d, dw = np.add.reduceat(ev, starts), np.add.reduceat(ev * w, starts)
    xs = np.add.reduceat((ev * w)[:, None] * x, starts, axis=0)
    return s, e, d, dw, xs, starts


def fit_cox(df: DataFrame, time: str, event: str, terms, weight: str | None = None, by: Sequence[str] = (), data: CoxData | None = None) -> Fit:
    """Newton steps; all groups advance together."""
    own, data = data is None, data or CoxData(df, time, event, terms, weight, by)
    p, lay = data.p, data.lay
    groups = [tuple(r) for r in data.packed.select(*data.by).distinct().collect()]
    betas = {k: np.zeros(p) for k in groups}
    infos, lls, moved, best = {}, {}, {}, {}
    for _ in range(MAX_STEPS):
        edges, offsets = data.blocks(data.totals(betas))
        inner = data.interior_pass(betas, offsets)
        sums = {k: list(_event_terms(lay, betas[k], v["s"], v["e"], v["d"], v["dw"], v["xs"])) for k, v in edges.items()}
        for rec in inner.to_dict("records"):
            k, acc = tuple(rec[c] for c in data.by), np.asarray(rec["acc"])
            sums[k][0] += acc[0]
            sums[k][1] = sums[k][1] + acc[1:1 + p]
            sums[k][2] = sums[k][2] + acc[1 + p:].reshape(p, p)
        worst = 0.0
        new = {}
        for k, (ll, u, info) in sums.items():
            if k in best and ll < best[k][0] - 1e-9 * abs(best[k][0]):
                new[k] = (betas[k] + best[k][1]) / 2  # overshoot: halve the step
                worst = 1.0
                continue
            best[k] = (ll, betas[k])
            inv, bad = safe_inverse(info[None])
            step = inv[0] @ u
            infos[k], lls[k], moved[k] = (inv[0], bool(bad[0])), ll, float(np.abs(step).max())
            new[k] = betas[k] + step
            worst = max(worst, moved[k])
        betas = new
        if worst < TOLERANCE:
            break
    else:
        unsettled(f"cox fit of {time}", worst)
    counts = data.kept.groupBy(*data.by).agg(F.count("*").alias("n"), F.sum("_d").alias("events")).collect()
    sizes = {tuple(r[c] for c in data.by): (r["n"], r["events"]) for r in counts}
    out = pd.DataFrame([
        {**dict(zip(data.by, k)), "beta": b.tolist(), "bread": infos[k][0].ravel().tolist(), "cov": infos[k][0].ravel().tolist(),
         "n": sizes[k][0], "df": float(sizes[k][1] - p), "dispersion": 1.0, "rss": lls[k], "singular": infos[k][1], "moved": moved[k]}
        for k, b in betas.items()
    ])
    schema = coef_schema(data.rows, data.by)
    table = local_frame(df.sparkSession, out[[f.name for f in schema.fields]], schema)
    if own:
        data.drop()
    return Fit("cox", "cox", data.terms, list(data.named_by), table.drop("_all"), True, time, weight, {"event": event})


def score_residuals(df: DataFrame, time: str, event: str, terms, key: str, fit: Fit, weight: str | None = None, strata: str | None = None,
                    data: CoxData | None = None) -> DataFrame:
    """Row score residuals ``u0..up`` at the fitted coefficients (rows in the model frame)."""
    carry = [key] + ([strata] if strata and strata != key else [])
    by = fit.by
    data = data or CoxData(df, time, event, terms, weight, by, carry)
    p, lay = data.p, data.lay
    betas = {tuple(r[c] for c in by) if by else (0,): np.array(r["beta"]) for r in fit.table.collect()}
    edges, offsets = data.blocks(data.totals(betas))
    inner = data.interior_pass(betas, offsets, hazards=True)
    edge_at, ends = {}, {}
    inner_by = {}
    for rec in inner.to_dict("records"):
        inner_by.setdefault(tuple(rec[c] for c in data.by), []).append((rec["_part"], np.asarray(rec["acc"])))
    firsts = {(tuple(r[c] for c in data.by), r["_part"]): r["_t0"] for r in data.packed.select(*data.by, "_part", "_t0").distinct().collect()}
    for k, v in edges.items():
        h, b, hc, bc, xbar = _hazard_terms(lay, v["s"], v["e"], v["d"], v["dw"])
        steps = [(t, 0, i, np.concatenate([[h[i]], b[i]])) for i, t in enumerate(v["t"])]
        steps += [(firsts[(k, part)], 1, part, acc) for part, acc in inner_by.get(k, [])]
        total = np.zeros(1 + p)
        for t, kind, i, acc in sorted(steps, key=lambda z: (z[0], z[1])):
            total = total + acc
            if kind == 0:
                edge_at[(*k, t)] = (total, hc[i], bc[i], xbar[i])
            else:
                ends[(*k, i)] = total
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((betas, offsets, edge_at, ends))
    xs_cols = [f"x{i}" for i in range(p)]
    gb = data.by
    keep = [f"_c_{c}" for c in carry]

    def walk(batches):
        betas, offsets, edge_at, ends = shared.value
        gp = [*gb, "_part"]
        now, run, left = None, None, None
        for pdf in _whole_times(batches, gp):
            starts = list(_runs(pdf, gp)) + [len(pdf)]
            for a, b in zip(starts[:-1], starts[1:]):
                g = pdf.iloc[a:b]
                key = tuple(g[c].iloc[0] for c in gp)
                if key != now:
                    now = key
                    run, left = (offsets[key].copy(), ends[key].copy()) if key in offsets else (None, None)
                beta = betas[key[:-1]]
                x, ev = g[xs_cols].to_numpy(dtype=float), g["_d"].to_numpy(dtype=float)
                at_edge = g["_edge"].notna().to_numpy()
                cum = np.zeros((len(g), 1 + p))
                hc, bc, xbar = np.zeros(len(g)), np.zeros((len(g), p)), np.zeros((len(g), p))
                t = g["_t"].to_numpy()
                for tv in np.unique(t[at_edge]):
                    sel = at_edge & (t == tv)
                    cum[sel], hc[sel], bc[sel], xbar[sel] = edge_at[(*key[:-1], tv)]
                if (~at_edge).any():
                    gi = g.loc[~at_edge]
                    s, e, d, dw, _, st = _at_times(lay, gi, xs_cols, beta, run)
                    run = s[-1]
                    h, bv, hcv, bcv, xb = _hazard_terms(lay, s, e, d, dw)
                    steps = np.column_stack([h, bv])
                    spent = np.cumsum(steps, axis=0)
                    through = left - (spent - steps)
                    left = left - spent[-1]
                    rep = np.repeat(np.arange(len(st)), np.diff(np.append(st, len(gi))))
                    cum[~at_edge], hc[~at_edge], bc[~at_edge], xbar[~at_edge] = through[rep], hcv[rep], bcv[rep], xb[rep]
                r = np.exp(x @ beta)
                u = ev[:, None] * (x - xbar) - r[:, None] * (x * cum[:, :1] - cum[:, 1:])
                u += (ev * r)[:, None] * (x * hc[:, None] - bc)
                out = g[[*gb, "_w", *keep]].copy()
                for i in range(p):
                    out[f"u{i}"] = u[:, i]
                yield out

    schema = T.StructType([data.rows.schema[c] for c in [*gb, "_w", *keep]] + [T.StructField(f"u{i}", T.DoubleType()) for i in range(p)])
    need = [*gb, "_part", "_t", "_d", "_w", "_edge", *xs_cols, *keep]
    out = data.sorted.select(*need).mapInPandas(walk, schema)
    return out.select(*by, F.col("_w"), *[F.col(f"_c_{c}").alias(c) for c in carry], *[f"u{i}" for i in range(p)])


def dfbeta_cox(fit: Fit, df: DataFrame, time: str, event: str, terms, key: str, weight: str | None = None, prefix: str = "dfbeta_",
               data: CoxData | None = None) -> DataFrame:
    """Score residual (times weight) times inverse information, per row."""
    p = len(fit.terms)
    d = fit.attach(score_residuals(df, time, event, terms, key, fit, weight, data=data), ("bread",))
    return d.select(*fit.by, key, *[
        F.expr("_w * (" + " + ".join(f"_bread[{i * p + j}] * u{j}" for j in range(p)) + ")").alias(f"{prefix}{n}")
        for i, n in enumerate(fit.names)
    ])


def fit_survey_cox(df: DataFrame, time: str, event: str, terms, key: str, weight: str, strata: str | None = None, by: Sequence[str] = ()) -> Fit:
    """Design-weighted Cox fit with sandwich variance by strata."""
    carry = [key] + ([strata] if strata and strata != key else [])
    data = CoxData(df, time, event, terms, weight, by, carry)  # partitioned once, used by both steps
    fit = fit_cox(df, time, event, terms, weight, by, data)
    u = score_residuals(df, time, event, terms, key, fit, weight, strata, data)
    z = u.select(*fit.by, *([strata] if strata else []), *[F.expr(f"_w * u{i} AS z{i}") for i in range(len(fit.terms))])
    return sandwich(fit, z, strata)
