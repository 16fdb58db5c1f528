"""Quality classifier (5), nearest neighbours (7), toxicity (10)."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsemill.llm import ann, quality_classifier, toxicity
from sparsemill.llm.common import bounded_sample

from .helpers import corpus, frame, prose, simple

# Toxicity


def brute_marginals(emit, start, steps):
    """By enumerating all state sequences."""
    n = len(emit)
    total, one, pairs = 0.0, np.zeros(n), np.zeros((n, 4))
    for s in itertools.product((0, 1), repeat=n):
        x = start * s[0] + sum(e for e, y in zip(emit, s, strict=True) if y) + sum(steps[a] for a, b in zip(s, s[1:], strict=False) if b)
        p = np.exp(x)
        total += p
        one += p * np.array(s)
        for t in range(n - 1):
            pairs[t, 2 * s[t] + s[t + 1]] += p
    return one / total, pairs / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    lengths = [5, 0, 1, 8, 3, 8, 2]
    at = np.concatenate([[0], np.cumsum(lengths)])
    emit, start, steps = rng.normal(0, 2, at[-1]), -0.7, np.array([-1.5, 0.8])
    one, pairs = toxicity.forward_backward(emit, at, start, steps)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if a < b:
            want = brute_marginals(emit[a:b], start, steps)
            assert np.allclose(one[a:b], want[0]) and np.allclose(pairs[a:b], want[1])


def toxic_corpus(n=1500, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 120)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumf", "Grumfed,", "snark", "snarkish"]))
        rows.append((i, " ".join(words)))
        if i % 4 != 3:
            labels.append((i, int(toxic), 1))
    return rows, labels


def test_toxic_documents_are_found(spark):
    rows, labels = toxic_corpus()
    hard = [(i, t) for i, t in [(r[0], r[1]) for r in corpus()] if i is None or i >= 900]
    hard = [(None if i is None else i + 10_000, t) for i, t in hard]
    lab = spark.createDataFrame([*labels, (0, 0, 1), (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.tag(simple(spark, rows + hard), lab).collect()
    assert len(got) == len(rows + hard) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    own = [r for r in got if r.doc_id is not None and r.doc_id < 10_000]
    wrong = [r.doc_id for r in own if r.predicted != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 15 and len([i for i in wrong if zlib.crc32(str(i).encode()) % 4 == 2]) <= 5
    text = dict(rows)
    spans = [text[r.doc_id][s.start : s.stop].lower() for r in own for s in r.spans]
    assert len(spans) > 400 and np.mean([any(x in s for x in ("grumf", "snark")) for s in spans]) > 0.98


def test_held_out_labels_and_metadata_have_no_influence(spark):
    rows, labels = toxic_corpus(400)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, q) for i, t, q in labels]
    scores = []
    for lab, docs in ((labels, simple(spark, rows)), (turned, simple(spark, rows).withColumn("lang", F.lit("de")).withColumn("source", F.lit("x")))):
        got = toxicity.tag(docs, spark.createDataFrame(lab, "doc_id long, toxic int, quality int"))
        scores.append({r.doc_id: r.score for r in got.collect()})
    assert scores[0] == scores[1]


@pytest.mark.parametrize("labels", [[], [(0, 1)], [(1, 0), (2, 0)]])
def test_without_labels_of_both_kinds(spark, labels):
    got = toxicity.tag(frame(spark), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert {r.score for r in got} == {0.0} and len(got) == len(corpus())
    assert toxicity.tag(frame(spark, []), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_near_copies_teach_once():
    rng = random.Random(1)
    base = prose(rng, 100)
    texts = [base, base + " more words", prose(rng, 100), "", "short one", base.replace("ka", "lu", 1), ""]
    buckets, _, _, at, _ = toxicity.tokens(pa.array(texts))
    assert toxicity.distinct_texts(buckets, at).tolist() == [0, 2, 3, 4, 6]


# Quality


@pytest.mark.parametrize("n", [20_000, 200_000])
@pytest.mark.parametrize(("good_share", "fires", "alarms", "within"), [(0.85, [0.9] * 7, [0.02] * 7, 0.05), (0.85, [0.7, 0.6, 0.5, 0.4, 0.5], [0.001, 0.002, 0.004, 0.001, 0.002], 0.05), (0.95, [0.8, 0.6, 0.7, 0.9, 0.5], [0.01] * 5, 0.1)])
def test_estimates_of_accuracies(n, good_share, fires, alarms, within):
    """Labellers of known accuracies: the model finds them and the good share, at every size; less well where most lone alarms are errors."""
    rng = np.random.default_rng(2)
    good = rng.random(n) < good_share
    votes = np.stack([np.where(rng.random(n) < np.where(good, a, f), quality_classifier.BAD, quality_classifier.GOOD) for f, a in zip(fires, alarms, strict=True)], axis=1)
    patterns, at, times = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, chance, posterior = quality_classifier.estimate(patterns, times.astype(float))
    assert abs(share - good_share) < 0.02
    assert np.abs(chance[:, 1, quality_classifier.BAD] - fires).max() < within
    assert np.abs(chance[:, 0, quality_classifier.BAD] - alarms).max() < 0.01
    assert ((posterior[at.ravel()] >= 0.5) == good).mean() > 0.97


def test_kinds_of_bad_texts():
    """Labellers that are each sure of another kind: none is taken for noise among good texts."""
    kinds = np.repeat([-1, 0, 1, 2, 3], [8000, 700, 300, 300, 250])
    votes = np.zeros((len(kinds), 4), np.int64)
    for k in range(4):
        votes[kinds == k, k] = quality_classifier.BAD
    patterns, at, times = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, _, posterior = quality_classifier.estimate(patterns, times.astype(float))
    assert ((posterior[at.ravel()] >= 0.5) == (kinds < 0)).all() and abs(share - 8000 / len(kinds)) < 0.02


def test_samples_are_bounded_in_rows_and_characters(spark):
    rows = [(1, "a" * 50)] * 5 + [(1, f"b{k:02}") for k in range(30)] + [(k, "c" * 10) for k in range(10, 40)]
    docs = simple(spark, rows).select("doc_id", "text", (F.col("doc_id") % 2).alias("by"))
    got = bounded_sample(docs, 12, 100, "by").collect()
    assert len({(r.doc_id, r.text) for r in got}) == len(got)
    for value in (0, 1):
        own = [r for r in got if r.by == value]
        assert 8 <= len(own) <= 12 and sum(len(r.text) for r in own) <= 100
    assert len(bounded_sample(docs, 1000, 10**6).collect()) == len(set(rows)) and bounded_sample(docs.limit(0), 5, 5, "by").count() == 0


def quality_corpus():
    rng = random.Random(6)
    rows = []
    for i in range(600):
        text = ". ".join(prose(rng, rng.randint(5, 15)).capitalize() for _ in range(rng.randint(1, 12)))
        if i % 10 == 1:
            text = " ".join(f"{w}{rng.choice(['***', '$$$', '&&&'])}" for w in text.split())
        elif i % 10 == 2:
            text = "\n".join(f"{prose(rng, 2).upper()}!!" for _ in range(30))
        elif i % 10 == 3:
            text = " ".join(f"{prose(rng, 1)} " * 15 for _ in range(8))
        rows.append((i, text))
    return rows


def test_bad_documents_go_and_good_ones_stay(spark):
    rows = quality_corpus()
    got = {r.doc_id: r.quality_score for r in quality_classifier.classify(simple(spark, rows)).collect()}
    wrong = [i for i, s in got.items() if (s >= 0.5) == (i % 10 in (1, 2, 3))]
    assert len(wrong) <= 10, wrong


def test_quality_of_hard_rows(spark):
    docs = frame(spark)
    out = quality_classifier.classify(docs)
    rows = out.collect()
    assert out.columns == [*docs.columns, "quality_score"] and len(rows) == len(corpus()) and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality_classifier.classify(frame(spark, [])).count() == 0


# Nearest neighbours


def brute(vectors, query, k=10):
    out = {}
    for i, v in vectors:
        if query(i):
            far = sorted((float(np.sqrt(((v - u) ** 2).sum())), j) for j, u in vectors if j != i and len(u) == len(v))
            out[i] = far[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, axis int, tab int, ids string")


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 24))
    rows = [(i, np.float32(centers[i % 12] * (1 + i % 3) + rng.normal(scale=0.4, size=24)).astype(float)) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # many copies of one vector
    bad = [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] * 24), (2300, [float("inf")] + [1.0] * 23), (2400, [None] + [1.0] * 23), (None, rows[0][1]), (2500, [])]
    other = [(3000, [1.0, 2.0, 2.0]), (3001, [1.0, 2.0, 3.0])]
    docs = table(spark, [*rows, *bad, *other, rows[0]])
    got = {}
    for r in ann.nearest(docs, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows, lambda i: i % 20 == 0)
    assert set(got) == {*want, 3000}
    assert [x[2] for x in got[3000]] == [3001] and got[3000][0][1] == pytest.approx(1.0)
    hits = 0
    for i, near in want.items():
        assert [x[0] for x in got[i]] == list(range(1, len(got[i]) + 1))
        assert [x[1:] for x in got[i]] == sorted(x[1:] for x in got[i])
        hits += len({x[2] for x in got[i]} & {j for _, j in near})
        if i >= 1000:  # a copy's nearest are the smallest ids of the other copies
            assert [x[2] for x in got[i]] == [j for _, j in near]
    assert hits / (10 * len(want)) >= 0.9


def hits(spark, rows, k, **options):
    """Share of the true nearest that are found, for every 20th vector."""
    want = brute(rows, lambda i: i % 20 == 0, k)
    got = {}
    for r in ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=k, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(got.get(i, set()) & {j for _, j in near}) for i, near in want.items()) / (k * len(want))


def test_one_rule_at_every_size(spark):
    """Hashes grow with the table, the part of it that is compared falls, and few probes find less."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(30, 64))
    rows = [(i, np.float32(centers[i % 30] + rng.normal(scale=0.5, size=64)).astype(float)) for i in range(1500)]
    assert hits(spark, rows, 10) >= 0.9
    spread = [(i, rng.normal(size=64).astype(np.float32).astype(float)) for i in range(1500)]
    assert hits(spark, spread, 10, tables=1, probed=0.5) < 0.99
    assert [ann.hashes_for(n) for n in (2, 500, 10_000, 10**6, 10**9)] == [3, 5, 6, 7, 10]
    assert ann.TABLES * ann.PROBED / 1500 ** (1 / 3) < 0.35


def test_reach_is_that_of_the_wanted_part_of_all_buckets():
    rng = np.random.default_rng(9)
    lost = ann.losses(rng.normal(size=(20, 14)), 1, 3)
    sums = (lost[:, 0, :, None, None] + lost[:, 1, None, :, None] + lost[:, 2, None, None, :]).reshape(20, -1)
    for part in (0.01, 0.1, 0.4):
        most = ann.reach(lost, part)
        got = (sums <= most[:, None]).mean(axis=1)
        assert np.abs(got - part).max() < 0.15 * part + 0.002
        for j in range(20):
            pairs = lost[j, 0, :, None] + lost[j, 1, None, :]
            want = np.flatnonzero(pairs.ravel() <= most[j])
            assert ann.prefixes(lost[j], most[j], 2).tolist() == want.tolist()


def test_short_lists_are_filled_exactly(spark):
    """Vectors of a rare length, and outlying ones, whose few probed buckets hold next to nothing."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).astype(np.float32).astype(float)) for i in range(400)]
    rows += [(1000 + 20 * i, rng.normal(size=128).astype(np.float32).astype(float)) for i in range(8)]
    got = {}
    for r in ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, tables=1, probed=0.0001).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, lambda i: i % 20 == 0)
    assert {i: len(x) for i, x in got.items()} == {i: len(x) for i, x in want.items()}
    assert {len(x) for x in got.values()} == {7, 10}
    assert got == {i: [j for _, j in near] for i, near in want.items()}


def test_no_vectors(spark):
    assert ann.nearest(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(table(spark, [(0, [1.0, 0.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_rotations_keep_lengths_and_blocks_split(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(50, 64))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))
    monkeypatch.setattr(ann, "BLOCK", 16)
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(2).normal(size=(300, 8)).astype(np.float32).astype(float))]
    got = ann.nearest(table(spark, rows), F.col("vec_id") % 10 == 0, k=3).collect()
    want = brute(rows, lambda i: i % 10 == 0, 3)
    hits = sum(len({r.vec_id for r in got if r.query_id == i} & {j for _, j in near}) for i, near in want.items())
    assert len(got) == 90 and hits >= 81
