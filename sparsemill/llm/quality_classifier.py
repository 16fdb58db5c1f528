"""Text quality without labels: heuristic labellers, a model of their accuracies, and a hashed linear scorer.

Labellers vote good, bad or nothing on each text. What all of them say together is
a vote pattern; how often each pattern occurs in the whole corpus is a small table
(3^labellers rows at most), from which expectation-maximisation estimates the
share of good texts and each labeller's chances of each vote on good and on bad
ones. Texts are bad in several ways: the bad class is a mixture of as many kinds as
there are labellers, each of which starts where one labeller is sure and the others
are not; good texts start as those that are seldom called bad. A labeller's accuracy on bad texts
is its mean over the kinds. The prior weighs as much as a few texts, whatever the
corpus, and a vote for nothing tells nothing. Where labellers err on few bad texts together, a lone
bad vote may be an error or a kind of its own; votes alone can't tell, and it counts as a kind. The posterior of a text's pattern is its soft label.

A logistic scorer learns the soft labels from hashed features: 3-grams of
character classes (letters by case, digits, blanks, each other character itself),
which don't depend on language, and binned counts. It learns from `sample`
rows and `learn_chars` characters at most, those with the smallest hashes of their ids,
rows that no longer fit passed over, which bounds what the driver reads; patterns are counted over, and scores given to, every document.

Defined results: a null text is an empty one; a text without words is scored like
any other; equal rows get equal scores; rows of null ids are scored, and may not
be learned from; in an empty table nothing is learned and nothing scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_sample, id_text, steps, stored
from .quality_rules import COUNTS, count_texts

GOOD, BAD, NOTHING = 0, 1, 2
GRAM_BITS = 14
SAMPLE = 6000
#: Characters of all texts that are learned from.
LEARN_CHARS = 24_000_000
#: Texts that the prior counts for, in each class.
PRIOR = 4.0
#: The same for what a kind's other labellers say.
OTHERS = 0.5


@dataclass(frozen=True)
class Labeller:
    """Bad where numerator / denominator is over `bad`, good where it is at most `good`; silent on texts under `least` words."""

    name: str
    numerator: str
    denominator: str
    good: float
    bad: float
    least: int = 0

    def vote(self) -> Column:
        x = F.col(self.numerator) / F.greatest(F.col(self.denominator), F.lit(1))
        return F.when(F.col("n_words") < self.least, NOTHING).when(x > self.bad, BAD).when(x <= self.good, GOOD).otherwise(NOTHING)


LABELLERS = (
    Labeller("symbols", "n_symbols", "n_words", 0.02, 0.25),
    Labeller("upper", "n_upper", "word_chars", 0.15, 0.4, 5),
    Labeller("marks", "n_marks", "n_words", 0.03, 0.5),
    Labeller("repeats", "n_repeat_words", "n_words", 0.25, 0.6, 50),
    Labeller("dup_lines", "n_dup_lines", "n_lines", 0.1, 0.6, 50),
)


def estimate(patterns: np.ndarray, times: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good texts, chances [labeller, class, vote], and each pattern's posterior of good. patterns: votes, a row each."""
    m = patterns.shape[1]
    seen = np.eye(3)[patterns]  # pattern, labeller, vote
    # Class 0 is good, class k + 1 the kind of bad texts that labeller k is sure of: chances of a bad vote, among votes for good or bad.
    alarm = np.full((m, m + 1), 0.2)
    alarm[:, 0] = 0.003
    alarm[np.arange(m), np.arange(m) + 1] = 0.9
    # The prior holds that good texts are seldom called bad, and that each kind has its labeller.
    prior = OTHERS * np.stack([1 - alarm, alarm], axis=2)
    for kind in [np.zeros(m, int), np.arange(m) + 1]:
        own = alarm[np.arange(m), kind]
        prior[np.arange(m), kind] = PRIOR * np.stack([1 - own, own], axis=1)
    share = np.append(0.8, np.full(m, 0.2 / m))
    prior_share = PRIOR * share
    post = np.repeat(share[None], len(patterns), axis=0)
    for _ in range(rounds):
        like = np.exp(np.einsum("plv,lcv->pc", seen[:, :, :2], np.log(np.stack([1 - alarm, alarm], axis=2))))
        joint = like * share
        new = joint / joint.sum(axis=1, keepdims=True)
        done = np.abs(new - post).max(initial=0.0) < 1e-9
        post = new
        weight = post * times[:, None]
        share = (weight.sum(axis=0) + prior_share) / (times.sum() + PRIOR)
        votes = np.einsum("pc,plv->lcv", weight, seen[:, :, :2]) + prior
        alarm = votes[:, :, 1] / votes.sum(axis=2)
        if done:
            break
    both = np.stack([weight[:, 0], weight[:, 1:].sum(axis=1)], axis=1)
    chance = np.einsum("pc,plv->lcv", both, seen) + np.stack([prior[:, 0], prior[:, 1:].mean(axis=1)], axis=1) @ np.eye(2, 3)
    return float(share[0]), chance / chance.sum(axis=2, keepdims=True), post[:, 0]


def _classes() -> np.ndarray:
    """A class under 64 for each byte."""
    out = np.zeros(256, np.uint32)  # lower-case letters and bytes of non-ASCII characters
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[9, 11, 12, 13, 32]] = 3
    out[10] = 4
    for k, b in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        out[b] = 5 + k
    out[[*range(9), *range(14, 32), 127]] = 62
    return out


CLASS = _classes()
#: Bins of counts that are features after the grams: each ratio in tenths, and words by powers of two.
RATIOS = (("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("n_upper", "word_chars"), ("n_symbols", "n_words"), ("n_marks", "n_words"))
WIDTH = (1 << GRAM_BITS) + 11 * len(RATIOS) + 1


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-grams of character classes by place of their last byte (0 for a text's first two bytes), and whether one ends there."""
    data, bounds = as_bytes(texts)
    c = CLASS[data]
    code = np.zeros(len(c), np.uint32)
    code[2:] = c[:-2] << np.uint32(12) | c[1:-1] << np.uint32(6) | c[2:]
    inside = np.ones(len(c) + 2, bool)
    inside[bounds] = inside[bounds + 1] = False
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64), inside[: len(c)]


def bins(counted: dict[str, np.ndarray]) -> np.ndarray:
    """Features of binned counts, a row for each text: their numbers. Texts under 50 words have one bin for shares of repeats."""
    out = []
    for k, (a, b) in enumerate(RATIOS):
        ratio = np.minimum(counted[a] / np.maximum(counted[b], 1), 1.0)
        at = np.ceil(ratio * 9).astype(np.int64)
        if k < 2:
            at = np.where(counted["n_words"] < 50, 10, at)
        out.append((1 << GRAM_BITS) + 11 * k + at)
    return np.stack(out, axis=1)


@dataclass
class Scorer:
    weights: np.ndarray

    def score(self, texts: pa.Array, counted: dict[str, np.ndarray]) -> np.ndarray:
        """The probability of good of each text."""
        _, bounds = as_bytes(texts)
        code, inside = grams(texts)
        total = np.concatenate([[0.0], np.cumsum(np.where(inside, self.weights[code], 0.0))])
        n = np.maximum(np.diff(bounds) - 2, FEW)
        margin = (total[bounds[1:]] - total[bounds[:-1]]) * SCALE / n + self.weights[bins(counted)].sum(axis=1) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


#: Gram frequencies are multiplied by this, which sets them on a level with the bins. In texts of fewer grams than FEW they weigh less.
SCALE, FEW = 10.0, 300


def train(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, soft: np.ndarray, rounds: int = 150, l2: float = 1e-4, rate: float = 0.3) -> Scorer:
    """Logistic regression on soft labels by AdaGrad over the whole sample. doc, feature, value: non-zero features."""
    w, seen = np.zeros(WIDTH), np.full(WIDTH, 1e-8)
    n = len(soft)
    for _ in range(rounds):
        margin = np.bincount(doc, w[feature] * value, n) + w[-1]
        gap = soft - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        g = np.bincount(feature, gap[doc] * value, WIDTH) / n - l2 * w
        g[-1] = gap.mean()
        seen += g * g
        w += rate * g / np.sqrt(seen)
    return Scorer(w)


def learn(docs: DataFrame, counted: DataFrame, sample: int = SAMPLE, learn_chars: int = LEARN_CHARS) -> Scorer | None:
    """A scorer for docs (doc_id, text), whose counts are given; None for an empty table."""
    votes = [x.vote().alias(f"v{k}") for k, x in enumerate(LABELLERS)]
    table = counted.select(*votes).groupBy(*[f"v{k}" for k in range(len(votes))]).count().orderBy(*[f"v{k}" for k in range(len(votes))]).collect()
    if not table:
        return None
    rows = np.array([tuple(r) for r in table], np.int64)
    _, _, good = estimate(rows[:, :-1], rows[:, -1].astype(float))
    posterior = {tuple(r[:-1]): g for r, g in zip(rows.tolist(), good.tolist(), strict=True)}
    some = counted.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    # An id may have any number of rows: rows are bounded after ids are.
    texts = bounded_sample(id_text(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text"), sample, learn_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                data, bounds = as_bytes(step.column(1))
                code, inside = grams(step.column(1))
                features, values = [], []
                counts_ = dict(zip(COUNTS, count_texts(step.column(1)), strict=True))
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own, n = np.unique(code[a:b][inside[a:b]], return_counts=True)
                    features.append(np.concatenate([own, bins({k: v[i : i + 1] for k, v in counts_.items()})[0]]))
                    values.append(np.concatenate([n * SCALE / max(b - a - 2, FEW), np.ones(len(RATIOS))]))
                yield pa.RecordBatch.from_arrays([step.column(0), step.column(2), pa.array(features, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64())), *(pa.array(counts_[c]) for c in COUNTS)], ["doc_id", "text_key", "features", "vals", *COUNTS])

    found = texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_key long, features array<long>, vals array<double>, " + ", ".join(f"{c} long" for c in COUNTS)).select("doc_id", "features", "vals", "text_key", *votes).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("text_key", "ascending")])
    if not found.num_rows:
        return None
    lists, value = found.column("features").combine_chunks(), found.column("vals").combine_chunks()
    doc = np.repeat(np.arange(found.num_rows), np.diff(np.asarray(lists.offsets)))
    soft = np.array([posterior[k] for k in zip(*(found.column(f"v{j}").to_pylist() for j in range(len(votes))), strict=True)])
    return train(doc, np.asarray(lists.flatten()), np.asarray(value.flatten()), soft)


def count_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                yield pa.RecordBatch.from_arrays([step.column(0), *(pa.array(x) for x in count_texts(step.column(1)))], ["doc_id", *COUNTS])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def classify(docs: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, learn_chars: int = LEARN_CHARS, id_col: str = "doc_id", text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with score_col: the probability that a row's text is good, 1 where nothing could be learned. Rows under the threshold are the rejected ones."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scorer = learn(rows, stored(count_all(rows), "counts"), sample, learn_chars)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if scorer is None:
            return pa.array(np.ones(len(texts)))
        out = [np.zeros(0)]
        for part in steps(pa.RecordBatch.from_arrays([texts], ["text"])):
            out.append(scorer.score(part.column(0), dict(zip(COUNTS, count_texts(part.column(0)), strict=True))))
        return pa.array(np.concatenate(out))

    return docs.withColumn(score_col, score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
