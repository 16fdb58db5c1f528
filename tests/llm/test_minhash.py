"""Near copies by Jaccard similarity, as the pipeline drops them."""

import random

import pytest

import corpus_pipeline as pipeline
from sparsemill.llm import minhash

from .helpers import frame, prose, simple, texts
from .test_simhash import fingerprint


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def wanted(rows):
    """component_id of each row, by comparing all pairs."""
    sets, of = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if of[a] != of[b] and jaccard(sets[a], sets[b]) >= 0.8:
                old, new = of[a], of[b]
                of = [new if x == old else x for x in of]
    ids = [[i for k, (i, _) in enumerate(rows) if of[k] == c and i is not None] for c in of]
    return [min(x, default=None) for x in ids]


@pytest.mark.parametrize("tile", [256, 3])
def test_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    rng = random.Random(6)
    base, rows = prose(rng, 150).split(), texts()
    for k in range(30):  # a chain and a ball of copies with words changed
        words = base[:]
        for _ in range(k % 5):
            words[rng.randrange(150)] = "changed"
        rows.append((2000 + k, " ".join(words)))
    got = sorted(map(tuple, minhash.near_copies(simple(spark, rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted(((i, c) for (i, _), c in zip(rows, wanted(rows), strict=True)), key=str)


def test_copies_with_changed_words_go(spark):
    """Copies of a similarity over 0.8 whose fingerprints differ in more than two bits."""
    rng = random.Random(5)
    rows = []
    for k in range(12):
        words = prose(rng, 150).split()
        rows.append((k, " ".join(words)))
        words[40], words[90] = "changed", "words"
        rows.append((100 + k, " ".join(words)))
        assert jaccard(shingles(rows[-1][1]), shingles(rows[-2][1])) >= 0.8
    assert sum((fingerprint(rows[2 * k][1]) ^ fingerprint(rows[2 * k + 1][1])).bit_count() > 2 for k in range(12)) > 5
    got = pipeline.near_dedup(spark, simple(spark, rows).select("doc_id", "text"), "").collect()
    assert sorted(r.doc_id for r in got) == list(range(12))


def test_empty_table(spark):
    assert minhash.near_copies(frame(spark, [])).count() == 0
