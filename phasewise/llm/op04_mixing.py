"""Mixing sources to target weights. DataFrame functions only.

Words are counted for every document and summed per source (map-side, so a source with a third of all
rows is one partial row per task). Sources in code point order, null last, weigh ``WEIGHTS`` in turn and
share all words by weight; a target stops at ``MOST`` times the source's words and the excess is shared
again by weight among the others until none is above. A document is taken floor(rate) times, rate =
target / words of the source, and once more when a draw keyed by seed and doc_id is below the fraction.

Edge cases: null text has size 0; null source is a source of its own, last; a source without words has
target 0 and takes 0; repeated rows draw alike; null doc_id draws by an empty key; an empty table gives
no rows. Other columns pass through ``mix`` untouched and are ignored by ``rates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.functions import keyed
from phasewise.llm.common import WORD, join_checked, store
from phasewise.operators.order import running_sums

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 11


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size); the number of sources is not bounded."""
    totals = store(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # rank in code point order by range partitions, null last
    named = totals.where("source IS NOT NULL").withColumn("one", F.lit(1).cast("bigint"))
    ranked = running_sums(named, ["source"], {"rank": "one"}).select("source", "source_size", "rank")
    last = totals.where("source IS NULL").crossJoin(named.agg((F.count("*") + 1).alias("rank"))).select("source", "source_size", "rank")
    turn = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = store(ranked.unionByName(last).select("source", "source_size", turn.alias("weight")), "weights")
    whole = lambda where: table.where(where).agg(F.sum("source_size"), F.sum("weight")).first()
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # sources above their most, as scalars: what is left to share and the weight that shares it
    left, weight = total, whole("true")[1] or 0
    while weight:
        stopped = whole(F.expr(f"cast({most} * source_size as decimal(38,0)) * {weight} < cast(weight as decimal(38,0)) * {left}"))
        capped = most * (stopped[0] or 0)
        new = (total - capped, (whole("true")[1] or 0) - (stopped[1] or 0))
        if new == (left, weight):
            break
        left, weight = new
    share = F.expr(f"cast(weight * {left} as double) / {weight}") if weight else F.lit(0.0)
    above = F.expr(f"cast({most} * source_size as decimal(38,0)) * {weight} < cast(weight as decimal(38,0)) * {left}") if weight else F.lit(True)
    return table.withColumn("target", F.when(above, F.expr(f"cast({most} * source_size as double)")).otherwise(share))


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, text, source)."""
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    sizes = store(sizes, "sizes")
    targets = store(source_targets(sizes, weights, most).select(F.col("source").alias("_source"), "source_size", "target"), "targets")
    joined = join_checked(sizes, targets, F.expr("source <=> _source"), "inner", 64)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    draw = keyed.uniform(seed, "mix", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    out = joined.withColumn("rate", rate).withColumn("copies", copies.cast("bigint"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; the texts do not move."""
    sizes = store(docs.select(F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    targets = source_targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    table = store(targets.select(F.col("source").alias("_source"), rate.alias("_rate")), "rates")
    draw = keyed.uniform(seed, "mix", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    joined = join_checked(docs, table, F.expr("cast(source as string) <=> _source"), "inner", 64)
    copies = F.floor("_rate") + F.when(draw < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    copied = joined.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>"))))
    return copied.select(*[docs[c] for c in docs.columns])
