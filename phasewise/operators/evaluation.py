"""Pooling over imputations and scoring of estimates and imputations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasewise.functions.keyed import normal, uniform
from phasewise.functions.scalar import expit
from phasewise.functions.tails import t_ppf_array
from phasewise.operators.columns import Roles
from phasewise.operators.order import exact_quantiles
from phasewise.session import cut, join_small, per_row_numpy, settle

LARGE_T_DF = 1e12


def pool_rubin(est: DataFrame, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """Pool estimates over imputations: mean, total variance, df, limits, missing information."""
    m = F.count("*").cast("double")
    u, b = F.avg(F.col("se") * F.col("se")), F.coalesce(F.var_samp("estimate"), F.lit(0.0))
    pooled = est.groupBy(*by).agg(m.alias("m"), F.avg("estimate").alias("estimate"), u.alias("within"), b.alias("between"))
    pooled = pooled.withColumn("_extra", (1 + 1 / F.col("m")) * F.col("between")).withColumns({
        "se": F.sqrt(F.col("within") + F.col("_extra")), "r": F.col("_extra") / F.nullif(F.col("within"), F.lit(0.0)),
    })
    pooled = pooled.withColumn("df", F.when(F.col("r") > 0, (F.col("m") - 1) * F.pow(1 + 1 / F.col("r"), 2)).otherwise(LARGE_T_DF))
    pooled = pooled.withColumn("fmi", (F.col("r") + 2 / (F.col("df") + 3)) / (F.col("r") + 1))
    keep = [*by, "m", "estimate", "se", "df", "fmi"]

    def limits(pdf: pd.DataFrame) -> pd.DataFrame:
        q = t_ppf_array(0.5 + level / 2, pdf["df"].to_numpy(dtype=float))
        return pdf.assign(lower=pdf["estimate"] - q * pdf["se"], upper=pdf["estimate"] + q * pdf["se"])

    base = pooled.select(*keep)
    schema = T.StructType([*base.schema.fields, T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])
    return per_row_numpy(base, limits, schema)[0]


def _joined(true: DataFrame, imp: DataFrame, roles: Roles, cols: Sequence[str]) -> DataFrame:
    t = true.select(roles.key, *[F.col(c).alias(f"_t_{c}") for c in cols])
    extra = [c for c in ("imp_id", "trial", "fold") if c in imp.columns]
    return imp.select(roles.key, *extra, *[F.col(c).alias(f"_i_{c}") for c in cols]).join(t, roles.key, "inner")


def standardized_mse(true: DataFrame, imp: DataFrame, roles: Roles, by: Sequence[str] = (), sd: str = "samp") -> DataFrame:
    """Squared error of numeric validated columns over the true variance, averaged over columns."""
    cols = [b for _, b in roles.numeric_pairs]
    j = _joined(true, imp, roles, cols)

    def _share(c):
        return F.col(f"_m_{c}") / F.nullif(F.col(f"_v_{c}"), F.lit(0.0))

    var = F.var_samp if sd == "samp" else F.var_pop
    spread = true.agg(*[var(c).alias(f"_v_{c}") for c in cols])
    sums = j.groupBy(*by).agg(*[F.avg(F.pow(F.col(f"_i_{c}") - F.col(f"_t_{c}"), 2)).alias(f"_m_{c}") for c in cols])
    total = sum((_share(c) for c in cols[1:]), _share(cols[0]))
    return sums.join(F.broadcast(spread)).select(*by, (total / len(cols)).alias("mse"))


def category_error(true: DataFrame, imp: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    """Mean mismatch rate over categorical validated columns."""
    cols = [b for _, b in roles.categorical_pairs]
    j = _joined(true, imp, roles, cols)
    rates = [F.avg((F.col(f"_i_{c}").cast("string") != F.col(f"_t_{c}").cast("string")).cast("double")) for c in cols]
    return j.groupBy(*by).agg((sum(rates[1:], rates[0]) / len(cols)).alias("error"))


# Numbers and least rows of a block of rows, rows and columns of a tile of distances.
BLOCK_VALUES = 2_000_000
BLOCK = 2_000
TILE = (128, 1_000)
MOST_PARTS = 256
# One numeric column: width of a box of the line, polynomials of a box, most combinations of levels.
BOX = 0.5
DEGREE = 18
MAX_COMBINATIONS = 256


def energy_distance(x: DataFrame, y: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), key: str | None = None,
                    block_rows: int | None = None) -> DataFrame:
    """2E|X-Y| - E|X-X'| - E|Y-Y'| on pooled z-scores and dummies, floored at 0: ``energy_distances`` of one group."""
    one = lambda df: df.withColumn("_all", F.lit(0))
    return energy_distances(one(x), one(y), ["_all"], numeric, categorical, block_rows).select("energy")


def energy_distances(
    x: DataFrame, y: DataFrame, by: Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (), block_rows: int | None = None,
) -> DataFrame:
    """Energy distance for every group of ``by`` in one job: (by, energy). Rows are scaled within their group.

    Equal rows are counted once with a multiplicity. With one numeric column (and at most MAX_COMBINATIONS combinations of
    levels) the sums over all pairs come from one sorted pass, see ``_line_sums``. With more the work is quadratic
    whatever the engine, see ``_block_sums``. A group that lacks one of the samples or a
    number has a null energy. Group columns must not be null.
    """
    by = list(by)
    both = x.select(*by, F.lit(0).alias("_s"), *numeric, *categorical).unionByName(y.select(*by, F.lit(1).alias("_s"), *numeric, *categorical))
    stats = both.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(numeric)], *[F.stddev_samp(c).alias(f"_d{i}") for i, c in enumerate(numeric)],
        F.sum(1 - F.col("_s")).cast("double").alias("_n0"), F.sum("_s").cast("double").alias("_n1"),
    )
    stats = settle(stats)[0]
    levels = {c: sorted(r[0] for r in both.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().collect()) for c in categorical}
    scaled = [(F.col(c) - F.col(f"_m{i}")) / F.coalesce(F.nullif(F.col(f"_d{i}"), F.lit(0.0)), F.lit(1e-8)) for i, c in enumerate(numeric)]
    rows = join_small(both, stats, by, "inner")
    if len(numeric) == 1 and np.prod([len(v) + 1 for v in levels.values()]) <= MAX_COMBINATIONS:
        sums = _line_sums(rows, by, F.coalesce(scaled[0], F.lit(float("nan"))), levels)
    else:
        parts = scaled + [F.when(F.col(c).cast("string") == F.lit(v), 1.0).otherwise(0.0) for c in categorical for v in levels[c]]
        sums = _block_sums(rows, by, parts, block_rows or max(BLOCK, BLOCK_VALUES // max(1, len(parts))))
    mean = lambda a, b: F.coalesce(F.sum(F.when((F.col("s1") == a) & (F.col("s2") == b), F.col("total"))), F.lit(0.0))
    known = F.count(F.when(F.col("total").isNull() | F.isnan("total"), 1)) == 0
    wide = sums.groupBy(*by).agg(F.when(known, mean(0, 1)).alias("_xy"), mean(0, 0).alias("_xx"), mean(1, 1).alias("_yy"))
    each = lambda s, a, b: F.col(s) / F.nullif(F.col(a) * F.col(b), F.lit(0.0))
    value = 2 * each("_xy", "_n0", "_n1") - each("_xx", "_n0", "_n0") - each("_yy", "_n1", "_n1")
    return join_small(wide, stats, by, "inner").select(*by, F.when(value.isNotNull(), F.greatest(value, F.lit(0.0))).alias("energy"))


def _kinds(rows: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of two tiles; pairs too near for the product form are subtracted."""
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    size = a2[:, None] + b2[None, :]
    d2 = size - 2.0 * (a @ b.T)
    i, j = np.nonzero(d2 < 1e-4 * size)
    d2[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(d2)


def _block_sums(rows: DataFrame, by: Sequence[str], parts: Sequence[Column], block_rows: int) -> DataFrame:
    """(by, s1, s2, total): distances of all pairs of rows, summed.

    Each group's rows are packed into blocks of about ``block_rows`` numbers of rows, in smaller groups into as many as there are
    cores. Only blocks of one group meet, each two once, and each task reduces two blocks to one number: no pair of rows is
    ever a row of a table. The blocks are kept once; where at least a quarter of all pairs of blocks are of one group, partitions
    meet by reading them, so that what is shuffled and written grows with the rows. Many small groups are shuffled to their pairs.
    """
    width, cores = len(parts), rows.sparkSession.sparkContext.defaultParallelism
    n = F.col("_n0") + F.col("_n1")
    blocks = F.greatest(F.lit(1), F.ceil(n / block_rows), F.least(F.ceil(n / min(block_rows, BLOCK)), F.lit(cores))).cast("int")
    rows = rows.select(*by, blocks.alias("_nb"), "_s", F.array(*parts).alias("v")).groupBy(*by, "_nb", "_s", "v").agg(F.count("*").alias("c"))
    packed = rows.withColumn("b", F.pmod(F.xxhash64("v"), F.col("_nb")).cast("int")).groupBy(*by, "_nb", "_s", "b").agg(
        F.collect_list("v").alias("v"), F.collect_list("c").alias("c"))  # about block_rows rows
    packed = packed.select(*by, (F.col("_s") * F.col("_nb") + F.col("b")).alias("id"), "_nb", "_s", F.flatten("v").alias("v"), "c")
    sizes = rows.select(*by, "_nb").distinct().agg(F.sum("_nb").alias("n"), F.sum(F.col("_nb") * F.col("_nb")).alias("n2"),
                                                   F.sum(F.col("_nb") * (2 * F.col("_nb") + 1)).alias("pairs")).first()

    def reduce_pairs(batches):
        for pdf in batches:
            total = []
            for r in pdf.itertuples(index=False):
                a, b = np.asarray(r.v1, float).reshape(-1, width), np.asarray(r.v2, float).reshape(-1, width)
                ca, cb = np.asarray(r.c1, float), np.asarray(r.c2, float)
                part = 0.0
                for i in range(0, len(a), TILE[0]):
                    for j in range(0, len(b), TILE[1]):
                        part += ca[i:i + TILE[0]] @ _distances(a[i:i + TILE[0]], b[j:j + TILE[1]]) @ cb[j:j + TILE[1]]
                total.append(2.0 * part if r.s1 == r.s2 and r.i != r.j else part)
            yield pdf[[*by, "s1", "s2"]].assign(total=total)

    on, all_blocks = [*by, "i", "j"], 2 * (sizes["n"] or 1)
    sides = [[*by, F.col("id").alias(at), F.col("_s").alias(f"s{k}"), F.col("v").alias(f"v{k}"), F.col("c").alias(f"c{k}")] for at, k in (("i", 1), ("j", 2))]
    if (sizes["n"] or 1) > 1 and 4 * sizes["n2"] >= sizes["n"] ** 2:
        # about one block a partition; a task reads one partition of either side
        packed = cut(packed.repartition(int(min(all_blocks, MOST_PARTS))))
        left, right = packed.select(*sides[0]).alias("l"), packed.select(*sides[1]).alias("r")
        same = F.col("i") <= F.col("j")
        for c in by:
            same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
        pairs = left.hint("shuffle_replicate_nl").join(right, same, "inner").select(*[F.col(f"l.{c}") for c in by], "i", "j", "s1", "s2", "v1", "v2", "c1", "c2")
    else:
        # one shuffle a side, about one pair of blocks a partition
        count = int(max(cores, min(sizes["pairs"], 20_000)))
        left = packed.select(*sides[0], F.explode(F.sequence(F.col("id"), 2 * F.col("_nb") - 1)).alias("j"))
        right = packed.select(*sides[1], F.explode(F.sequence(F.lit(0), F.col("id"))).alias("i"))
        pairs = left.repartition(count, *on).join(right.repartition(count, *on), on, "inner").select(*on, "s1", "s2", "v1", "v2", "c1", "c2")
    return pairs.mapInPandas(reduce_pairs, f"{_kinds(rows, by)}s1 int, s2 int, total double")


def _line_sums(rows: DataFrame, by: Sequence[str], value: Column, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """The same for one number and levels, without meeting pairs: one sort, work in proportion to the rows.

    Two rows of the same levels are |z - z'| apart: running counts and sums along the sorted line give their total exactly, and
    range partitions are joined by their totals. Rows of other levels are sqrt((z - z')^2 + q) apart, q the squared distance of
    their dummies, 1 at least. That is analytic within 1 of the line, so inside a box of width 0.5 a polynomial of DEGREE terms
    gives it to 8.1^-18, less than a double resolves: a box of rows enters by DEGREE sums. Boxes in use grow at most with
    the cube root of the rows, as z-scores have variance 1.
    """
    names = list(levels)
    place, size, places = F.lit(0), 1, [()]
    for c in names:
        at = F.call_function("array_position", F.array(*[F.lit(v) for v in levels[c]]).cast("array<string>"), F.col(c).cast("string"))
        place = place + F.coalesce(at, F.lit(0)) * size
        size *= len(levels[c]) + 1
        places = [(*p, i) for i in range(len(levels[c]) + 1) for p in places]  # by ascending code
    apart = np.array([[sum(0 if a == b else 1 if 0 in (a, b) else 2 for a, b in zip(p, q)) for q in places] for p in places])
    rows = rows.select(*by, place.cast("int").alias("_k"), "_s", value.alias("z")).groupBy(*by, "_k", "_s", "z").agg(F.count("*").alias("c"))
    ranged = rows.repartitionByRange(*[F.col(c) for c in [*by, "_k", "z"]]).sortWithinPartitions(*by, "_k", "z")
    nodes = np.cos((2 * np.arange(DEGREE) + 1) * np.pi / (2 * DEGREE))
    key = [*by, "_k"]

    def walk(batches):
        line, boxes = {}, {}  # of this partition: a row for each group it touches and each box in use
        for pdf in batches:
            for k, g in pdf.groupby(key, sort=False):
                z, w = g["z"].to_numpy(float), g["c"].to_numpy(float)[None, :] * (g["_s"].to_numpy()[None, :] == [[0], [1]])
                now = line.setdefault(k, np.concatenate([[z[0]], np.zeros(7)]))
                n, t = now[1:3, None] + np.cumsum(w, axis=1), now[3:5, None] + np.cumsum(w * z, axis=1)
                below = z * n - t
                now[5:8] += [2 * (w[0] @ below[0]), w[0] @ below[1] + w[1] @ below[0], 2 * (w[1] @ below[1])]
                now[1:3], now[3:5] = n[:, -1], t[:, -1]
                box = np.floor(np.where(np.isfinite(z), z, 0.0) / BOX)
                term = np.cos(np.arange(DEGREE)[:, None] * np.arccos(np.clip(2 * (z / BOX - box) - 1, -1.0, 1.0)))
                start = np.flatnonzero(np.concatenate([[True], box[1:] != box[:-1]]))
                sums = [np.add.reduceat(term * v, start, axis=1) for v in w]
                for j, b in enumerate(box[start]):
                    boxes[(*k, b)] = boxes.get((*k, b), 0.0) + np.concatenate([v[:, j] for v in sums])
        found = [(*k, None, v.tolist()) for k, v in line.items()] + [(*k, v.tolist()) for k, v in boxes.items()]
        yield pd.DataFrame(found, columns=[*key, "box", "v"])

    def finish(pdf):
        total = np.zeros((2, 2))
        lone = pdf[pdf["box"].isna()]
        for _, g in lone.groupby("_k"):
            v = np.stack(g["v"].to_numpy())
            v = v[np.argsort(v[:, 0], kind="stable")]
            n, t = np.cumsum(v[:, 1:3], axis=0) - v[:, 1:3], np.cumsum(v[:, 3:5], axis=0) - v[:, 3:5]
            cross = v[:, 3:5].T @ n - v[:, 1:3].T @ t  # [a, b]: rows of a above all earlier rows of b
            total += cross + cross.T
            total[0, 0] += v[:, 5].sum()
            total[0, 1] += v[:, 6].sum()
            total[1, 1] += v[:, 7].sum()
        part = pdf[~pdf["box"].isna()]
        used, at = np.unique(part["box"].to_numpy(float), return_inverse=True)
        codes, which = np.unique(part["_k"].to_numpy(), return_inverse=True)
        moments = np.zeros((len(codes), 2, len(used), DEGREE))
        np.add.at(moments, (which, slice(None), at), np.stack(part["v"].to_numpy()).reshape(-1, 2, DEGREE))
        moments[..., 1:] *= 2.0
        basis = np.cos(np.arange(DEGREE)[:, None] * np.arccos(nodes)) / DEGREE
        weight = (moments @ basis).reshape(2 * len(codes), -1)
        x = ((used[:, None] + (nodes + 1) / 2) * BOX).ravel()
        q = np.repeat(np.repeat(apart[np.ix_(codes, codes)], 2, axis=0), 2, axis=1)
        for one in np.unique(q[q > 0]):
            sums = np.zeros(q.shape)
            for lo in range(0, len(x), 256):
                sums += weight[:, lo:lo + 256] @ (np.sqrt((x[lo:lo + 256, None] - x[None, :]) ** 2 + one) @ weight.T)
            sums = np.where(q == one, sums, 0.0)
            total += [[sums[a::2, b::2].sum() for b in (0, 1)] for a in (0, 1)]
        out = pd.DataFrame({"s1": [0, 0, 1], "s2": [0, 1, 1], "total": [total[0, 0], total[0, 1], total[1, 1]]})
        return out.assign(**{c: pdf[c].iloc[0] for c in by})[[*by, "s1", "s2", "total"]]

    partial = ranged.mapInPandas(walk, f"{_kinds(rows, by)}_k int, box double, v array<double>")
    return partial.groupBy(*by).applyInPandas(finish, f"{_kinds(rows, by)}s1 int, s2 int, total double")


def imputation_loss(true: DataFrame, imp: DataFrame, roles: Roles) -> DataFrame:
    """mse and error weighted by the share of numeric / categorical targets, plus energy."""
    num, cat = [b for _, b in roles.numeric_pairs], [b for _, b in roles.categorical_pairs]
    total = len(num) + len(cat)
    mse = standardized_mse(true, imp, roles).select(F.col("mse") * F.lit(len(num) / total))
    err = category_error(true, imp, roles).select(F.col("error") * F.lit(len(cat) / total))
    energy = energy_distance(true, imp, num, cat)
    parts = [t.toDF("v").select(F.lit(n).alias("part"), "v") for n, t in (("mse", mse), ("error", err), ("energy", energy))]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return long.groupBy().pivot("part", ["mse", "error", "energy"]).agg(F.first("v")).withColumn(
        "loss", F.col("mse") + F.col("error") + F.col("energy"))


def variance_ratio(orig: DataFrame, imp: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Mean over imputations of the variance, over the original variance; levels by code; 4 decimals."""
    from phasewise.operators.columns import level_codes

    def coded(df, by):
        out = df.select(*by, *numeric, *categorical)
        for c in categorical:
            # Codes count levels present in each table separately, as a factor made from it would.
            if by:
                lv = df.where(F.col(c).isNotNull()).select(*by, c).distinct()
                from pyspark.sql import Window

                lv = lv.withColumn("_code", F.row_number().over(Window.partitionBy(*by).orderBy(c)).cast("double"))
            else:
                lv = level_codes(df, c, "_code")
            out = join_small(out, lv, [*by, c]).withColumn(c, F.col("_code").cast("double")).drop("_code")
        return out

    cols = [*numeric, *categorical]
    o = coded(orig, []).agg(*[F.var_samp(c).alias(c) for c in cols]).unpivot([], cols, "variable", "original")
    per = coded(imp, ["imp_id"]).groupBy("imp_id").agg(*[F.var_samp(c).alias(c) for c in cols])
    i = per.unpivot(["imp_id"], cols, "variable", "v").groupBy("variable").agg(F.avg("v").alias("imputed"))
    ratio = F.when(F.col("original") != 0, F.col("imputed") / F.col("original"))
    return o.join(i, "variable").select(
        "variable", F.round("original", 4).alias("original"), F.round("imputed", 4).alias("imputed"), F.round(ratio, 4).alias("ratio"))


def rmse_by_method(est: DataFrame, ref: DataFrame, on: Sequence[str] = ("rep", "term"), by: Sequence[str] = ("method", "design", "term")) -> DataFrame:
    """Root mean squared difference from the full-validation estimate, paired by key."""
    r = ref.select(*on, F.col("estimate").alias("_ref"))
    return est.join(r, list(on), "inner").groupBy(*by).agg(
        F.sqrt(F.avg(F.pow(F.col("estimate") - F.col("_ref"), 2))).alias("rmse"))


def bias_table(est: DataFrame, truth: DataFrame, by: Sequence[str] = ("method", "design", "term")) -> DataFrame:
    """Bias, percent bias, relative bias and median difference per method, design and term."""
    d = join_small(est, truth, ["term"], "inner").withColumn("_d", F.col("estimate") - F.col("truth"))
    med = exact_quantiles(d, "_d", [0.5], by).select(*by, F.col("value").alias("median_diff"))
    out = d.groupBy(*by).agg(F.avg("estimate").alias("mean_estimate"), F.avg("_d").alias("bias"), F.first("truth").alias("_t"))
    out = out.withColumns({"percent_bias": 100 * F.col("bias") / F.nullif(F.col("_t"), F.lit(0.0)), "relative_bias": F.col("bias") / F.nullif(F.abs(F.col("_t")), F.lit(0.0))})
    return out.join(med, list(by), "inner").drop("_t")


def ci_coverage(est: DataFrame, truth: DataFrame, by: Sequence[str] = ("method", "design", "term")) -> DataFrame:
    """Share of intervals that contain the truth."""
    d = join_small(est, truth, ["term"], "inner")
    hit = (F.col("truth") >= F.col("lower")) & (F.col("truth") <= F.col("upper"))
    return d.groupBy(*by).agg(F.avg(hit.cast("double")).alias("coverage"))


def oracle_coverage(est: DataFrame, truth: DataFrame, by: Sequence[str] = ("method", "design", "term")) -> DataFrame:
    """Coverage of estimate +- 1.96 x empirical SD over replicates."""
    sd = est.groupBy(*by).agg(F.stddev_samp("estimate").alias("_sd"))
    d = join_small(join_small(est, sd, list(by), "inner"), truth, ["term"], "inner")
    hit = F.abs(F.col("estimate") - F.col("truth")) <= F.lit(1.96) * F.col("_sd")
    return d.groupBy(*by).agg(F.avg(hit.cast("double")).alias("coverage"))


def density_table(sources: Mapping[str, DataFrame], column: str | Column, bins: int, base: str) -> DataFrame:
    """Histogram density of a column per source over the range of the ``base`` source."""
    col = F.col(column) if isinstance(column, str) else column
    lo, hi = sources[base].agg(F.min(col), F.max(col)).first()
    width = (hi - lo) / bins or 1.0
    out = None
    for name, df in sources.items():
        v = df.select(F.lit(name).alias("source"), col.cast("double").alias("_v")).where(F.col("_v").between(lo, hi))
        out = v if out is None else out.unionByName(v)
    b = F.least(F.floor((F.col("_v") - F.lit(float(lo))) / F.lit(float(width))), F.lit(bins - 1)).cast("int")
    counts = out.groupBy("source", b.alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("_tot"))
    return counts.join(F.broadcast(totals), "source").select(
        "source", "bin", "n", (F.col("n") / F.col("_tot") / F.lit(float(width))).alias("density"))


def inject_error_continuous(df: DataFrame, column: str, name: str, key: str, seed, slope: float = 1.0, intercept: float = 0.0,
                            z: Mapping[str, float] | None = None, noise_var: float = 0.1) -> DataFrame:
    """Surrogate = exp(intercept + slope * centred log x + covariate effect + noise).

    Covariates with more than three distinct values are centred.
    """
    z = dict(z or {})
    many = {c: df.select(c).where(F.col(c).isNotNull()).distinct().limit(4).count() > 3 for c in z}
    stats = df.agg(F.avg(F.log(column)).alias("_m"), *[F.avg(c).alias(f"_z{i}") for i, c in enumerate(z)]).first()
    lin = F.lit(float(intercept)) + F.lit(float(slope)) * (F.log(column) - F.lit(stats["_m"]))
    for i, (c, b) in enumerate(z.items()):
        lin = lin + F.lit(float(b)) * (F.col(c) - F.lit(stats[f"_z{i}"] if many[c] else 0.0))
    return df.withColumn(name, F.exp(lin + F.lit(float(noise_var) ** 0.5) * normal(seed, name, key)))


def inject_error_category(df: DataFrame, column: str, name: str, levels: Sequence, key: str, seed, accuracy: float = 0.8,
                          z: Mapping[str, float] | None = None) -> DataFrame:
    """Keep the true level with probability expit(logit(accuracy) + z effects), else another level at random."""
    z = dict(z or {})
    lin = F.lit(float(np.log(accuracy / (1 - accuracy))))
    if z:
        stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(z)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(z)]).first()
        for i, (c, b) in enumerate(z.items()):
            lin = lin + F.lit(float(b)) * (F.col(c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"])
    others = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v != F.col(column))
    pick = F.element_at(others, (F.floor(uniform(seed, f"{name}|other", key) * F.size(others)) + 1).cast("int"))
    return df.withColumn(name, F.when(uniform(seed, f"{name}|keep", key) > expit(lin), pick).otherwise(F.col(column)))
