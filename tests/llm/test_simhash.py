"""SimHash (9), and components of graphs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparsemill.llm import components, simhash

from .helpers import frame, simple, texts


def fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(items, radius=2):
    """component_id of each (id, fingerprint), by comparing all pairs."""
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if (items[a][1] ^ items[b][1]).bit_count() <= radius:
                parent[root(a)] = root(b)
    lows = {}
    for a, (i, _) in enumerate(items):
        if i is not None:
            lows[root(a)] = min(i, lows.get(root(a), i))
    return [lows.get(root(a)) for a in range(len(items))]


def test_against_all_pairs(spark):
    items = [(i, fingerprint(t)) for i, t in texts()]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(items, linked(items), strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(frame(spark)).collect()), key=str) == want


def test_random_fingerprints_with_chains(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):  # chains and balls: a few bits off another one
        x = rng.choice(prints)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    prints += [0, 1, (1 << 64) - 1, (1 << 64) - 2]
    items = list(enumerate(prints))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in items], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components(df).collect()}
    assert [got[i] for i, _ in items] == linked(items)


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = [base ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)]
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)], "doc_id long, fp long")
    got = [r.component_id for r in simhash.components(df).collect()]
    assert set(got) == set(linked(list(enumerate(prints))))


def test_majority():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 254, 255, 256, 1000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > n)
        assert simhash.majority_bits(h) == want
    assert simhash.majority_bits(np.zeros(0, np.uint64)) == 0


def test_empty_table_and_only_nulls(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = simhash.near_duplicates(simple(spark, [(None, None), (None, "")])).collect()
    assert [tuple(r) for r in rows] == [(None, "0" * 16, None)] * 2


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_star_forest(spark, shape):
    rng = random.Random(2)
    edges = {"path": [(k, k + 1) for k in range(60)], "star": [(500, k) for k in range(60)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "none": []}[shape]
    got = {r.a: r.b for r in components.star_forest(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {}
    for a, b in edges:
        x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
        if x is not y:
            x |= y
            group.update(dict.fromkeys(y, x))
    assert {a: got.get(a, a) for a in group} == {a: min(g) for a, g in group.items()}


def test_shared_folder_is_used(spark):
    assert simhash.fingerprints(frame(spark)).agg(F.count("*")).first()[0] == len(texts())
