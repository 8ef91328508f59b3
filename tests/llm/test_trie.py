"""Conversation trie against a recursive version, and the centroid rollup against sums over ancestors."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from phasewise.llm import op13_trie, queries
from test_operators import rows_of

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [r[3:] for r in sorted(v, key=lambda r: r[:3])] for c, v in own.items()}
    members, stops = collections.defaultdict(list), collections.defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + turns[c][h:])
        stops[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return [
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(stops[node]))).encode()).hexdigest())
        for node, m in members.items()
    ]


def key(row):
    return row[1], row[0], row[-1]


@pytest.fixture(scope="module")
def odd_conversations(spark):
    """Nulls, ties, repeated rows, shared heads, missing bases, one long conversation and a large group of copies."""
    rows = [(c, t, "user" if t % 2 else "bot", f"turn {t} of {c % 3}") for c in range(0, 40) for t in range(c % 7)]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(60) for t in range(5)]
    rows += [(2005, t, "user", f"long {t % 9}") for t in range(300)] + [(2006, t, None, f"long {t % 9}") for t in range(40)]
    rows += [(77, None, None, None), (77, None, "", ""), (77, 1, "user", None), (77, 1, None, "x"), (77, 1, None, "x"), (78, 3, "é", "ünï " * 4000)]
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (-7, 1, "a", "b"), (-5, 0, "a", "c"), (3001, 1, "user", "few"), (3003, 0, "1:user", "x")]
    return spark.createDataFrame([(*r, *[7] * 6) for r in rows], "conv_id bigint, turn bigint, role string, text string, id int, depth int, part int, n int, k1 int, comp int")


@pytest.mark.parametrize("piece", [op13_trie.PIECE, 40])
def test_whole_query(spark, odd_conversations, piece):
    """All in tasks, and most of it by rounds over components."""
    rows = rows_of(odd_conversations, "conv_id", "turn", "role", "text")
    got = rows_of(op13_trie.trie(odd_conversations, piece), *COLUMNS)
    assert sorted(got, key=key) == sorted(slow_trie(rows), key=key)


def test_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/conversations.parquet")
    got = rows_of(op13_trie.trie(docs), *COLUMNS)
    assert sorted(got, key=key) == sorted(slow_trie(rows_of(docs, "conv_id", "turn", "role", "text")), key=key)


def test_empty_and_turnless(spark, odd_conversations):
    assert op13_trie.trie(odd_conversations.where("false")).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "gone")], "conv_id bigint, turn bigint, role string, text string")
    assert zlib.crc32(b"1") % 9 >= 1
    assert rows_of(op13_trie.trie(one), *COLUMNS) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_sql_on_odd_rows(spark, odd_conversations, tmp_path):
    odd_conversations.select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "c"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    found = db.sql(queries.SQL["op13_trie"])
    at = [found.columns.index(c) for c in COLUMNS]
    want = slow_trie(rows_of(odd_conversations, "conv_id", "turn", "role", "text"))
    assert sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("shape", ["chain", "star", "bush", "forest"])
def test_centroid_totals(shape):
    rng = np.random.default_rng(4)
    n = 400
    parent = np.array([-1] + [{"chain": i - 1, "star": 0, "bush": int(rng.integers(0, i)), "forest": int(rng.integers(-1, i))}[shape] for i in range(1, n)])
    values = rng.integers(0, 1 << 40, (n, 2))
    depth, size, want = np.zeros(n, np.int64), rng.integers(1, 5, n), values.copy()
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
    for i in range(n - 1, 0, -1):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
            want[parent[i]] += want[i]
    mixed = rng.permutation(n)
    place = np.empty(n, np.int64)
    place[mixed] = np.arange(n)
    moved = np.where(parent[mixed] >= 0, place[parent[mixed]], -1)
    assert (op13_trie.centroid_totals(moved, depth[mixed], size[mixed], values[mixed]) == want[mixed]).all()
