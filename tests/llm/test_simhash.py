"""SimHash near-dedup against brute force over all pairs."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from phasewise.llm import op11_simhash as simhash
from phasewise.llm.common import signed, store
from test_operators import rows_of, words

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, k=4):
    w = words(text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs, radius=4):
    """(id, fingerprint) pairs -> id: smallest id reachable."""
    root = {d: d for d, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(pairs, 2):
        if (x ^ y).bit_count() <= radius:
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    return {d: find(d) for d in root}


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    for radius in (1, 2, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and all(24 <= m.bit_count() <= 48 for m in masks)
        for _ in range(5_000):
            gone = sum(1 << int(p) for p in rng.choice(64, radius, replace=False))
            assert any(m & gone == 0 for m in masks)


def test_whole_query(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd_docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    rows = rows_of(docs, "doc_id", "text")
    prints = [(d, slow_fingerprint(t)) for d, t in rows]
    want = slow_components([p for p in prints if p[0] is not None])
    got = rows_of(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(((d, f"{x:016x}", None if d is None else want[d]) for d, x in prints), key=key)
    assert simhash.simhash_components(no_docs).count() == 0


def test_long_text_is_hashed_whole(monkeypatch):
    text = " ".join(f"w{i % 97}\t{i}" for i in range(3_000)) + " end"
    want = slow_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert simhash.fingerprint(text, 4) == want
    assert simhash.fingerprint("x" * 500, 4) == slow_fingerprint("x" * 500)


@pytest.mark.parametrize("tile,dense", [(4096, 32768), (3, 32768), (4096, 4)])
def test_crowded_neighbourhood(spark, tile, dense):
    """Clusters around a few points, by plain buckets, pairs of tiles and halfway points."""
    rng = np.random.default_rng(5)
    points = set()
    for centre in rng.integers(0, 1 << 64, 3, dtype=np.uint64):
        for _ in range(60):
            x = int(centre)
            for p in rng.choice(64, rng.integers(0, 8), replace=False):
                x ^= 1 << int(p)
            points.add(x)
    points |= {0, (1 << 64) - 1, 15, 31, 1 << 63}
    points = sorted(points)
    fps = store(spark.createDataFrame([(int(v),) for v in signed(np.array(points, np.uint64))], "fp bigint"), "fps")
    found = [(int(a) % 2**64, int(b) % 2**64) for a, b in rows_of(simhash.links(fps, 4, tile, dense), "a", "b")]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    want = slow_components([(p, p) for p in points])
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        u, v = find(a), find(b)
        root[max(u, v)] = min(u, v)
    assert {p: find(p) for p in points} == want


def test_one_doc_id_joins_its_texts(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "q r s t u v"), (7, "q r s t u v"), (9, "a b c d e f"), (4, "z y x w v u")], "doc_id bigint, text string")
    assert sorted(rows_of(simhash.simhash_components(docs), "doc_id", "component_id")) == [(4, 4), (5, 5), (5, 5), (7, 5), (9, 5)]
    assert sorted(d for d, in rows_of(simhash.keep_one(docs), "doc_id")) == [4, 5, 5]
