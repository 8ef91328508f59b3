"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

A turn is known by the SHA-256 of its role and text; a prefix by its length and 128 bits, the exclusive or of
hashes of (position, turn). Prefixes of one conversation follow from offsets of range parts, and a node's
parent from taking its last turn off again, so no conversation has to fit a task.

Subtree sums. A node's ``size``, the turns its members have from it on, is a subtree sum that the members give
at once. A component's centroid is its deepest node that holds half of the component's size or more. What lies
at and below it in the component is totalled and added along the path from the centroid to the component's
top, then the centroid goes: the trees below it and the rest above are components of at most half the size.
Every node lies on the path of few components, so long chains cost no more rounds than bushes.

Complete subtrees of at most PIECE turns go to tasks whole, many side by side in numpy arrays. The nodes above
them, their own sums enlarged by the subtrees', are split by the same rule in Spark rounds until components
have at most PIECE nodes.

Edge cases: rows without conv_id belong to no conversation; null role and null text are empty; null turns come
first; rows of equal turn are ordered by the SHA-256 of role and text, so repeated rows are turns one after
another; texts of any length are hashed where they lie; the root is a node even if every conversation is
turnless; an empty table has no node; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasewise.llm.common import discard, join_checked, store, whole_groups

PIECE = 1 << 17
HEAD = 8  # turns that a conversation may take from another
CHUNK = 4096  # ids of one hashed string chunk
KEY = ["depth", "k1", "k2"]


# --- turns and prefixes ----------------------------------------------------------------------------------------


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_hash, n_bytes, part) stored: turns by their 1-based place, narrow; parts follow each other in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_hash"),
        F.octet_length(text).cast("bigint").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_first("turn"), F.col("turn_hash"), F.col("row")]
    rows = store(rows.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = store(sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "ahead")
    here = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    out = join_checked(rows, sizes, ["conv_id", "part"], "inner", 24).withColumn("pos", F.col("ahead") + here)
    out = store(out.select("conv_id", "pos", "turn_hash", "n_bytes", "part"), "numbered")
    discard(rows, sizes)
    return out


def rebuilt(turns: DataFrame, every: int = 5, heads: int = HEAD + 1) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations as (conv_id, depth, turn_hash, n_bytes, part, n_turns), and (conv_id, n_turns).

    Conversation c starts with the first h turns of conversation c - c % ``every`` and goes on with its own after
    its first h; h is the CRC-32 of c % ``heads``.
    """
    # as many as each conversation has
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % every
    sizes = store(sizes.select("conv_id", "n", first.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h")), "sizes")
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = sizes.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = plan.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = store(plan.select("conv_id", "base", "h", "taken", "n_turns"), "plan")
    head = turns.where(f"pos < {heads} AND conv_id % {every} = 0").withColumnRenamed("conv_id", "base")
    head = head.join(plan.where("taken > 0"), "base").where("pos <= taken")
    columns = ["conv_id", "depth", "turn_hash", "n_bytes", "part", "n_turns"]
    head = head.withColumn("depth", F.col("pos")).withColumn("part", F.lit(-1)).select(columns)
    own = join_checked(turns, plan, "conv_id", "inner", 40).where("pos > h")
    own = own.withColumn("depth", F.col("taken") + F.col("pos") - F.col("h")).select(columns)
    out = store(head.unionByName(own), "rebuilt")
    discard(sizes)
    return out, plan.select("conv_id", "n_turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation: (conv_id, n_turns, n_bytes, depth, k1, k2, p1, p2), p1 and p2 its parent's bits."""
    lanes = [F.xxhash64(F.lit(i), "depth", "turn_hash").alias(f"l{i}") for i in (1, 2)]
    rows = turns.select("conv_id", "depth", "part", "n_bytes", "n_turns", *lanes)
    of_part = rows.groupBy("conv_id", "part").agg(*(F.bit_xor(f"l{i}").alias(f"l{i}") for i in (1, 2)))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = [F.coalesce(F.bit_xor(f"l{i}").over(before), F.lit(0)).alias(f"o{i}") for i in (1, 2)]
    ahead = store(of_part.select("conv_id", "part", *ahead), "ahead")
    here = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = join_checked(rows, ahead, ["conv_id", "part"], "inner", 32)
    out = out.withColumns({f"k{i}": F.col(f"o{i}").bitwiseXOR(F.bit_xor(f"l{i}").over(here)) for i in (1, 2)})
    out = out.withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"l{i}")) for i in (1, 2)})
    out = store(out.select("conv_id", "n_turns", "n_bytes", *KEY, "p1", "p2"), "prefixes")
    discard(ahead)
    return out


def nodes_of(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """One row a node, stored: id, parent (id), depth, k1, k2, conv_id, n_convs, n_bytes, size, parent_conv_id, n_children."""
    size = F.sum(F.col("n_turns") - F.col("depth") + 1)
    found = paths.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), size.alias("size"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"),
    )
    root = plan.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n_turns") + 1).alias("size")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = root.select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("n_bytes"), "size",
        *(F.lit(None).cast("bigint").alias(c) for c in ("p1", "p2")),
    )
    found = store(found.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "found")
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = store(found.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children")), "children")
    parents = found.join(children, KEY)
    parents = store(parents.select("depth", "k1", "k2", F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parents")
    out = join_checked(found, children, KEY, "left", 40).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    at = parents.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent", "parent_conv_id")
    out = store(join_checked(out, store(at, "above"), ["depth", "p1", "p2"], "left", 48).drop("p1", "p2"), "nodes")
    discard(found, children, parents)
    return out


# --- centroid decomposition ------------------------------------------------------------------------------------


def centroid_totals(parent: np.ndarray, depth: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (one row a node) over a forest.

    ``parent`` holds places in the arrays, -1 for a top; ``size`` any positive subtree sums, greater than every child's.
    All components are split side by side; a round takes each one's centroid out.
    """
    n = len(parent)
    size, total, alive = size.copy(), np.zeros_like(values), np.ones(n, bool)
    up = np.where(parent < 0, np.arange(n), parent)
    label = _tops(up)
    while alive.any():
        node = np.flatnonzero(alive)
        half = node[2 * size[node] >= size[label[node]]]
        half = half[np.lexsort((depth[half], label[half]))]
        centre = half[np.append(label[half][1:] != label[half][:-1], True)]
        tops = label[centre]
        # the centroid and its children become tops
        alive[centre] = False
        taken = np.zeros(n, bool)
        taken[centre] = True
        child = node[(parent[node] >= 0) & taken[parent[node]] & alive[node]]
        up[child], up[centre] = child, centre
        label = _tops(up)
        below = np.zeros_like(values)
        below[centre] = values[centre]
        head = label[node]
        under = parent[head]
        lower = alive[node] & (under >= 0) & taken[np.maximum(under, 0)]
        np.add.at(below, under[lower], values[node[lower]])
        # along the paths from the centroids to the tops of their components
        at, gone, add = centre, size[centre], below[centre]
        while len(at):
            total[at] += add
            more = at != tops
            at, tops, gone, add = parent[at[more]], tops[more], gone[more], add[more]
            size[at] -= gone
    return total


def _tops(up: np.ndarray) -> np.ndarray:
    while True:
        further = up[up]
        if (further == up).all():
            return up
        up = further


TOTALS = "id bigint, n_leaves bigint, saved bigint"


def _piece_task(batches):
    """Totals of whole components, which come sorted by ``comp``."""
    for t in whole_groups(batches, ["comp"], PIECE):
        node, above = t.column("id").to_numpy(), t.column("parent").fill_null(-1).to_numpy()
        by_id = np.argsort(node)
        at = np.minimum(np.searchsorted(node[by_id], above), len(node) - 1)
        place = by_id[at]
        comp = t.column("comp").to_numpy()
        inside = (node[place] == above) & (comp[place] == comp)
        values = np.stack([t.column(c).to_numpy() for c in ("n_leaves", "saved")], axis=1)
        total = centroid_totals(np.where(inside, place, -1), t.column("depth").to_numpy(), t.column("size").to_numpy(), values)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total[:, 0]), pa.array(total[:, 1])], ["id", "n_leaves", "saved"])


def _in_tasks(components: DataFrame) -> DataFrame:
    rows = components.select("comp", "id", "parent", "depth", "size", "n_leaves", "saved")
    return rows.repartition("comp").sortWithinPartitions("comp").mapInArrow(_piece_task, TOTALS)


def _split(heavy: DataFrame, ways: DataFrame, piece: int) -> DataFrame:
    """Totals of the nodes above the pieces: rounds over components of more than ``piece`` nodes, the others in tasks.

    ``heavy`` is a stored table with ``comp``; ``ways`` (conv_id, depth, id) the heavy nodes on the way of each conversation
    that is some heavy node's smallest member.
    """
    done = []
    state = heavy
    while True:
        sizes = store(state.groupBy("comp").agg(F.count("*").alias("c"), F.max("size").alias("whole")), "comps")
        large = store(sizes.where(f"c > {piece}").select("comp", "whole"), "large")
        rest = join_checked(state, large, "comp", "left_anti", 16)
        done.append(store(_in_tasks(rest), "totals"))
        if large.isEmpty():
            break
        state = join_checked(state, large, "comp", "inner", 16)
        centres = state.where("2 * size >= whole").groupBy("comp").agg(
            F.max("depth").alias("c_depth"), F.max_by("id", "depth").alias("centre"), F.max_by("conv_id", "depth").alias("c_conv"),
            F.max_by("size", "depth").alias("c_size"), F.min("depth").alias("top_depth"),
        )
        centres = store(centres, "centres")
        marked = join_checked(state.drop("whole"), centres.select("comp", "centre", "c_depth"), "comp", "inner", 40)
        step = lambda name, more: ways.select("conv_id", (F.col("depth") - more).alias("c_depth"), F.col("id").alias(name))
        marked = marked.join(step("at", 0), ["conv_id", "c_depth"], "left").join(step("next", 1), ["conv_id", "c_depth"], "left")
        marked = store(marked.withColumn("below", F.coalesce(F.expr("at = centre AND depth >= c_depth"), F.lit(False))), "marked")
        sums = marked.where("below").groupBy("comp").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        path = centres.join(sums, "comp").join(ways.withColumnRenamed("conv_id", "c_conv"), "c_conv").where("depth BETWEEN top_depth AND c_depth")
        path = store(path.select("id", "n_leaves", "saved", F.col("c_size").alias("gone")), "path")
        done.append(path.select("id", "n_leaves", "saved"))
        comp = F.when(F.col("below"), F.col("next")).otherwise(F.col("comp")).alias("comp")
        left = marked.where("id <> centre").select(comp, "id", "parent", "depth", "conv_id", "size", "n_leaves", "saved")
        smaller = join_checked(left, store(path.select("id", "gone"), "gone"), "id", "left", 16)
        state = store(smaller.withColumn("size", F.col("size") - F.coalesce("gone", F.lit(0))).drop("gone"), "state")
    total = done[0]
    for more in done[1:]:
        total = total.unionByName(more)
    return store(total.groupBy("id").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")), "heavy")


def rollup(nodes: DataFrame, paths: DataFrame, piece: int = PIECE) -> DataFrame:
    """(id, n_leaves, saved): subtree sums of ``n_leaves`` and ``saved`` of every node.

    ``nodes`` (id, parent, depth, k1, k2, conv_id, size, n_leaves, saved) and ``paths`` (conv_id, depth, k1, k2) are stored tables.
    """
    heavy = store(nodes.where(f"size > {piece} OR depth = 0"), "heavy")
    # the piece of a conversation starts below its last heavy node
    ways = store(join_checked(paths, heavy.where("depth > 0").select(*KEY, "id"), KEY, "inner", 48).select("conv_id", "depth", "id"), "ways")
    reach = store(ways.groupBy("conv_id").agg(F.max("depth").alias("reach")), "reach")
    first = join_checked(paths.select("conv_id", "depth", *KEY[1:]), reach, "conv_id", "left", 24)
    first = first.where("depth = coalesce(reach, 0) + 1")
    tops = nodes.where(f"size <= {piece} AND depth > 0").select(*KEY, F.col("id").alias("comp"))
    start = store(first.join(tops, KEY).select("conv_id", "comp"), "start")
    light = join_checked(nodes.where(f"size <= {piece} AND depth > 0"), start, "conv_id", "inner", 24)
    light = store(_in_tasks(light), "light")
    # their sums go to the heavy nodes above them
    under = nodes.where("depth > 0").join(light.withColumnRenamed("n_leaves", "nl").withColumnRenamed("saved", "sv"), "id")
    given = under.join(heavy.select(F.col("id").alias("parent")), "parent").groupBy("parent").agg(F.sum("nl").alias("nl"), F.sum("sv").alias("sv"))
    own = heavy.join(given.withColumnRenamed("parent", "id"), "id", "left")
    own = own.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("nl", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("sv", F.lit(0)))
    root = nodes.where("depth = 0").select("id").first()
    top = F.lit(root["id"] if root else 0).cast("bigint")
    own = store(own.select(top.alias("comp"), "id", "parent", "depth", "conv_id", "size", "n_leaves", "saved"), "own")
    known = own.select("conv_id").distinct()
    root = known.select("conv_id", F.lit(0).cast("bigint").alias("depth"), top.alias("id"))
    ways = store(ways.join(known, "conv_id", "left_semi").unionByName(root), "ways")
    return light.unionByName(_split(own, ways, piece))


# --- digests of long id lists ----------------------------------------------------------------------------------


def _chunk_task(batches):
    """Runs of one node's ids, in order, as text: (depth, k1, k2, low, ids)."""
    for t in whole_groups(batches, KEY, CHUNK, most=CHUNK):
        keys = np.stack([t.column(c).to_numpy() for c in KEY])
        ids = t.column("conv_id").to_pylist()
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1]).tolist()
        text = [",".join(map(str, ids[s:e])) for s, e in zip(cuts, [*cuts[1:], len(ids)])]
        columns = [pa.array(keys[i][cuts]) for i in range(3)] + [pa.array([ids[s] for s in cuts], pa.int64()), pa.array(text, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*KEY, "low", "ids"])


def _digest_task(batches):
    """SHA-256 of each node's chunks, which come in order; only the running digest is kept."""
    now, digest, rows = None, None, []

    def batch_of(rows):
        *keys, sums = zip(*rows)
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(sums)], [*KEY, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if key == now:
                digest.update(b",")
            else:
                if now is not None:
                    rows.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        if len(rows) >= CHUNK:
            yield batch_of(rows)
            rows = []
    if now is not None:
        yield batch_of([*rows, (*now, digest.hexdigest())])


def ends(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes where conversations end: digest of their ids, ascending, comma-joined.

    Range parts sort and write the ids; a digest runs over its node's chunks in order, a few bytes an id.
    """
    zero = F.lit(0).cast("bigint")
    at_root = plan.where("n_turns = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
    last = paths.where("depth = n_turns").select(*KEY, "conv_id").unionByName(at_root)
    ordered = last.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    chunks = store(ordered.mapInArrow(_chunk_task, "depth bigint, k1 bigint, k2 bigint, low bigint, ids string"), "chunks")
    dealt = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "low").select(*KEY, "ids")
    return store(dealt.mapInArrow(_digest_task, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"), "ends")


def trie(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row a node of the trie of the rebuilt conversations (conv_id, turn, role, text)."""
    turns = numbered(conversations)
    whole, plan = rebuilt(turns)
    paths = prefixes(whole)
    nodes = nodes_of(paths, plan)
    values = {
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint"),
        "saved": (F.col("n_convs") - 1) * F.col("n_bytes"),
    }
    own = store(nodes.withColumns(values).select("id", "parent", *KEY, "conv_id", "size", "n_leaves", "saved"), "weighed")
    total = rollup(own, paths, piece)
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(total, "id").join(ends(paths, plan), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    out = store(out, "trie")
    discard(turns, whole, paths, nodes, own)
    return out
