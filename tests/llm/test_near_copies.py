"""Near copies by wide SimHash fingerprints, as the pipeline drops them."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from sparsemill.llm import minhash, near_copies

from .helpers import frame, prose, simple, texts
from .test_minhash import wanted


@pytest.mark.parametrize("tile", [2048, 3])
def test_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = random.Random(8)
    base, rows = prose(rng, 150).split(), texts()
    for k in range(30):  # a chain and a ball of copies with words changed
        words = base[:]
        for _ in range(k % 5):
            words[rng.randrange(150)] = "changed"
        rows.append((2000 + k, " ".join(words)))
    for k in range(40):  # four shingles of five, and copies at exactly 0.8 of other sizes
        words = prose(rng, 5 * (1 + k % 4) + 4).split()
        rows += [(3000 + k, " ".join(words)), (4000 + k, " ".join(words[: len(words) - 1 - k % 4]))]
    got = sorted(map(tuple, near_copies.near_copies(simple(spark, rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted(((i, c) for (i, _), c in zip(rows, wanted(rows), strict=True)), key=str)


def test_radii_cover_the_similarity():
    rng = np.random.default_rng(9)
    most = np.zeros(2, int)
    for n in (5, 9, 10, 45, 90, 900):
        for _ in range(100):
            x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            shared = -(-8 * n // 9) if n % 9 == 0 else n * 4 // 5  # of n each, or all of the smaller set
            y = np.concatenate([x[:shared], rng.integers(0, 1 << 64, n - shared if n % 9 == 0 else 0, dtype=np.uint64)])
            a, b = (np.array(near_copies.fingerprint(s), np.int64).view(np.uint64) for s in (x, y))
            bits = np.bitwise_count(a ^ b)
            most = np.maximum(most, [bits[:2].sum(), bits.sum()])
    assert most[0] <= near_copies.FIRST_RADIUS and most[1] <= near_copies.RADIUS
    far = [np.bitwise_count(np.array(near_copies.fingerprint(rng.integers(0, 1 << 64, 50, dtype=np.uint64))).view(np.uint64)[:, None] ^ np.array(near_copies.fingerprint(rng.integers(0, 1 << 64, 50, dtype=np.uint64))).view(np.uint64)[:, None]).sum() for _ in range(100)]
    assert min(far) > near_copies.RADIUS


def test_the_stage_goes_by_fingerprints(spark, monkeypatch):
    """The pipeline's stage finds its pairs by SimHash, not by MinHash bands."""
    monkeypatch.setattr(minhash, "band_keys", None)
    rng = random.Random(5)
    rows = []
    for k in range(6):
        words = prose(rng, 150).split()
        rows.append((k, " ".join(words)))
        words[40], words[90] = "changed", "words"
        rows.append((100 + k, " ".join(words)))
    docs = simple(spark, rows).select("doc_id", "text")
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == list(range(6))
    monkeypatch.setattr(near_copies, "candidates", lambda *_: spark.createDataFrame([], "x array<long>"))
    assert pipeline.near_dedup(spark, docs, "").count() == 12


def test_empty_table(spark):
    assert near_copies.near_copies(frame(spark, [])).count() == 0
