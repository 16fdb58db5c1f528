"""Toxic spans and scores by a linear-chain conditional random field.

A token's features are its word and the word's beginnings, hashed, so that
inflected forms share a stem. Token labels come from document labels: in a sample
of labelled documents, features that stand in far more toxic than other ones (by a
log-likelihood ratio test and a ratio of rates) mark toxic tokens where they stand
in a toxic document; all other tokens are not toxic. The field has two states, a
weight for each hashed feature, and weights of transitions, so that neighbours of
toxic tokens count too. It is fitted
by its exact gradient from forward-backward marginals. Forward-backward over a
document gives each token's marginal; a document's score is a logistic function of
the greatest marginal and of the expected number of toxic tokens, fitted on the
same sample; runs of tokens that are toxic with a probability of a half or more
are offending spans.

The sample holds at most `per_class` rows of each label and `learn_chars` characters
of them, those with the smallest hashes of their ids, rows that no longer fit passed over
and near copies left out: that bounds what the driver reads. Scoring reads
every token of every document. Labels, lang, source and doc_id are no inputs.

Defined results: a null text is an empty one; an empty text gets the score of a
document without toxic tokens; documents that repeat an id in the labels are toxic
if any label says so; rows of null ids are not held out and get scores; without
toxic and other labels every score is 0; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_sample, crc_mod, id_text, steps
from .license_scan import WORD
from .text import LOWER, hash_prefix, mix, word_bounds, word_hashes

BUCKET_BITS = 20
#: Bytes of a word's beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6, 8)
FEATURES = len(BEGINNINGS) + 1
PER_CLASS = 1500
#: Characters of all texts of a label that are learned from.
LEARN_CHARS = 8_000_000
#: Folds by crc32 of the id; one of them is never learned from.
FOLDS, HELD_OUT = 4, 2
#: Exponents are kept within this.
LIMIT = 15.0


@dataclass
class Field:
    """Weights of state 1 against state 0: by feature bucket, at the start, and of transitions (from 0 or 1, to 1); and of the score."""

    words: np.ndarray
    start: float
    steps: np.ndarray
    score: np.ndarray


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of all texts' words (a row each), the words' byte bounds, each text's first word (one more than texts), and the lower-cased bytes."""
    data, bounds = as_bytes(texts)
    data = LOWER[data]
    starts, ends, at = word_bounds(WORD[data], bounds)
    buckets = np.empty((len(starts), FEATURES), np.int32)
    prefix = hash_prefix(data)
    for f, k in enumerate((1 << 62, *BEGINNINGS)):
        to = np.minimum(starts + k, ends)
        hashed = word_hashes(data, starts, to, prefix)
        if f:
            hashed = mix(hashed + np.uint64(f))
        buckets[:, f] = hashed >> np.uint64(64 - BUCKET_BITS)
    return buckets, starts, ends, at, data


def _layout(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with words, longest first; how many of them have a t-th word; where the t-th words of them begin in a time-major order."""
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    long = length[order]
    active = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), "left")
    return order, active, np.concatenate([[0], np.cumsum(active)])


def forward_backward(emit: np.ndarray, at: np.ndarray, start: float, steps_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability of state 1, and of the four pairs of states with the next token (0 for a text's last one), columns 00, 01, 10, 11.

    Messages are odds of state 1, one number for each token; all texts take a step at once.
    """
    order, active, first = _layout(at)
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((0, 4))
    # Place in time-major order of each token.
    t_of = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    rank = np.empty(len(at) - 1, np.int64)
    rank[order] = np.arange(len(order))
    place = first[t_of] + np.repeat(rank, np.diff(at))
    gain = np.empty(n)
    gain[place] = np.exp(np.clip(emit, -LIMIT, LIMIT))
    from0, from1 = np.exp(np.clip(steps_, -LIMIT, LIMIT))  # to state 1; to state 0 they are 1
    ahead, back = np.empty(n), np.ones(n)
    top = len(active)
    a = gain[: active[0]] * np.exp(np.clip(start, -LIMIT, LIMIT))
    ahead[: active[0]] = a
    for t in range(1, top):
        a = a[: active[t]]
        a = gain[first[t] : first[t + 1]] * (from0 + from1 * a) / (1.0 + a)
        np.clip(a, 1e-12, 1e12, out=a)
        ahead[first[t] : first[t + 1]] = a
    for t in range(top - 2, -1, -1):
        g = gain[first[t + 1] : first[t + 2]] * back[first[t + 1] : first[t + 2]]
        back[first[t] : first[t] + active[t + 1]] = np.clip((1.0 + from1 * g) / (1.0 + from0 * g), 1e-12, 1e12)
    odds = (ahead * back)[place]
    one = odds / (1.0 + odds)
    pairs = np.zeros((n, 4))
    inner = np.flatnonzero(t_of + 1 < np.repeat(np.diff(at), np.diff(at)))
    r, g = ahead[place[inner]], (gain * back)[place[inner + 1]]
    p = np.stack([np.ones_like(r), from0 * g, r, r * from1 * g], axis=1)
    pairs[inner] = p / p.sum(axis=1, keepdims=True)
    return one, pairs


def emissions(field: Field, buckets: np.ndarray) -> np.ndarray:
    return field.words[buckets].sum(axis=1, dtype=np.float64)


def token_labels(buckets: np.ndarray, at: np.ndarray, toxic: np.ndarray, least_ratio: float = 8.0, least_g: float = 25.0) -> np.ndarray:
    """1 for tokens of toxic texts with a feature that marks toxic texts."""
    text = np.repeat(np.arange(len(toxic)), np.diff(at))
    n1, n0 = np.zeros(1 << BUCKET_BITS, np.int32), np.zeros(1 << BUCKET_BITS, np.int32)
    for f in range(FEATURES):  # one at a time, for the driver's memory; each kind of feature has buckets of its own but for chance
        pairs = np.unique(text << BUCKET_BITS | buckets[:, f])
        own = toxic[pairs >> BUCKET_BITS] == 1
        word = pairs & (1 << BUCKET_BITS) - 1
        for n, x in ((n1, own), (n0, ~own)):
            n += np.bincount(word[x], minlength=1 << BUCKET_BITS).astype(np.int32)
    all1, all0 = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    q = all1 / (all1 + all0)
    n = np.maximum(n1 + n0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.nan_to_num(n1 * np.log(n1 / (n * q))) + np.nan_to_num(n0 * np.log(n0 / (n * (1 - q)))))
    ratio = ((n1 + 0.5) / (all1 + 1)) / ((n0 + 0.5) / (all0 + 1))
    marks = (g >= least_g) & (ratio >= least_ratio)
    against = (n0 >= 2) & (ratio < least_ratio)
    out = np.zeros(len(buckets), bool)
    for f in (*range(1, FEATURES), 0):  # from the shortest beginning to the whole word: the longest that is known decides
        out = (out | marks[buckets[:, f]]) & ~against[buckets[:, f]]
    return (out & (toxic[text] == 1)).astype(float)


def distinct_texts(buckets: np.ndarray, at: np.ndarray, kept: int = 16, alike: float = 0.6) -> np.ndarray:
    """Numbers of texts without near copies: copies of a text would make its words look like marks. Each text's `kept` smallest word hashes are its sketch."""
    with np.errstate(over="ignore"):
        order = mix(buckets[:, 0].astype(np.uint64) + np.uint64(1))
    having: dict[int, list[int]] = {}
    out = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        sketch = np.unique(order[a:b])[:kept].tolist()
        shared: dict[int, int] = {}
        for h in sketch:
            for j in having.get(h, ()):
                shared[j] = shared.get(j, 0) + 1
        if sketch and max(shared.values(), default=0) >= alike * len(sketch):
            continue
        for h in sketch:
            having.setdefault(h, []).append(i)
        out.append(i)
    return np.array(out, np.int64)


def choose(at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of some texts, and the place of each text's first among them (one more than texts)."""
    take = np.concatenate([np.arange(at[i], at[i + 1]) for i in some]) if len(some) else np.zeros(0, np.int64)
    return take, np.concatenate([[0], np.cumsum(np.diff(at)[some])]).astype(np.int64)


def _summary(one: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text: 1, the log-odds of the greatest marginal, the logarithm of the expected number of toxic tokens."""
    n = len(at) - 1
    out = np.zeros((n, 3))
    out[:, 0] = 1.0
    most = np.zeros(n)
    full = np.diff(at) > 0
    if full.any():
        most[full] = np.maximum.reduceat(one, at[:-1][full])
    total = np.concatenate([[0.0], np.cumsum(np.where(one >= 0.05, one, 0.0))])  # else long texts would add up to a toxic token
    most = np.clip(most, 1e-4, 1 - 1e-4)
    out[:, 1] = np.log(most / (1 - most))
    out[:, 2] = np.log(np.clip(total[at[1:]] - total[at[:-1]], 1e-2, 1e2))
    return out


def _summarized(field: Field, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """_summary of some neighbouring texts."""
    return _summary(forward_backward(emissions(field, buckets[at[0] : at[-1]]), at - at[0], field.start, field.steps)[0], at - at[0])


def fit(buckets: np.ndarray, at: np.ndarray, toxic: np.ndarray, shares: tuple[float, float], epochs: int = 12, l2: float = 1e-3, rate: float = 0.5) -> Field:
    """A field of texts and their labels. shares: how many documents a sampled one of label 0 and 1 stands for."""
    labels = token_labels(buckets, at, toxic)
    field = Field(np.zeros(1 << BUCKET_BITS, np.float32), -3.0, np.array([-3.0, -1.0]), np.zeros(3))
    seen_words, seen = np.full(1 << BUCKET_BITS, 1e-3, np.float32), np.full(3, 1e-3)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(toxic)), max(1, len(toxic) // 250)):
            take, own_at = choose(at, some)
            if not len(take):
                continue
            b, y = buckets[take], labels[take]
            one, pairs = forward_backward(emissions(field, b), own_at, field.start, field.steps)
            inner = pairs.sum(axis=1) > 0
            nxt = np.append(y[1:], 0.0)
            touched, where = np.unique(b, return_inverse=True)
            g = np.bincount(where.ravel(), np.repeat(y - one, FEATURES), len(touched)) - l2 * field.words[touched]
            seen_words[touched] += g * g
            field.words[touched] += rate * g / np.sqrt(seen_words[touched])
            heads = own_at[:-1][np.diff(own_at) > 0]
            whole = np.array([(y[heads] - one[heads]).sum(), ((1 - y) * nxt - pairs[:, 1])[inner].sum(), (y * nxt - pairs[:, 3])[inner].sum()])
            seen += whole * whole
            move = 0.3 * whole / np.sqrt(seen)
            field.start += move[0]
            field.steps += move[1:]
    x = np.concatenate([np.zeros((0, 3)), *(_summarized(field, buckets, at[i : i + 251]) for i in range(0, len(toxic), 250))])
    weight = np.where(toxic == 1, shares[1], shares[0])
    weight = weight / weight.mean()
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ field.score, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        move = np.linalg.solve(h, x.T @ (weight * (toxic - p)) - 1e-2 * field.score)
        field.score = field.score + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return field


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, learn_chars: int = LEARN_CHARS) -> Field | None:
    """A field from the labelled documents that aren't held out; None if a class has none."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    size = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return None
    some = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(some[0].union(some[1]))  # 2 * per_class rows at most
    # An id may have any number of rows: rows are bounded after ids are.
    rows = bounded_sample(id_text(docs).join(sample, "doc_id").select("doc_id", "toxic", "text"), per_class, learn_chars, "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                buckets, _, _, at, _ = tokens(step.column(2))
                lists = pa.ListArray.from_arrays(pa.array((at * FEATURES).astype(np.int32)), pa.array(buckets.ravel()))
                yield pa.RecordBatch.from_arrays([step.column(0), step.column(1), step.column(3), lists], ["doc_id", "toxic", "text_key", "buckets"])

    found = rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "doc_id long, toxic int, text_key long, buckets array<int>").toArrow().combine_chunks()
    found = found.sort_by([("doc_id", "ascending"), ("text_key", "ascending")])
    if not found.num_rows or len(set(found.column("toxic").to_pylist())) < 2:
        return None
    lists = found.column("buckets").combine_chunks()
    toxic = np.asarray(found.column("toxic")).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets)))]).astype(np.int64) // FEATURES
    buckets = np.asarray(lists.flatten()).reshape(-1, FEATURES)
    some = distinct_texts(buckets, at)
    take, at = choose(at, some)
    buckets, toxic = buckets[take], toxic[some]
    del found, lists, take
    if len(set(toxic.tolist())) < 2:
        return None
    share = tuple(size[y] / max(1, int((toxic == y).sum())) for y in (0, 1))
    return fit(buckets, at, toxic, share)


def score(docs: DataFrame, field: Field | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start, stop in characters, mean marginal) of each row's whole text."""
    SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("marginal", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                n = step.num_rows
                if field is None:
                    yield pa.RecordBatch.from_arrays([step.column(0), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(SPAN))], ["doc_id", "score", "spans"])
                    continue
                buckets, starts, ends, at, data = tokens(step.column(1))
                one, _ = forward_backward(emissions(field, buckets), at, field.start, field.steps)
                value = 1 / (1 + np.exp(-np.clip(_summary(one, at) @ field.score, -30, 30)))
                hot = one >= 0.5
                spans: list[list[dict]] = [[] for _ in range(n)]
                if hot.any():
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    _, bounds = as_bytes(step.column(1))
                    first, last, by = word_bounds(hot, at)
                    for i in np.flatnonzero(np.diff(by)).tolist():
                        for a, b in zip(first[by[i] : by[i + 1]].tolist(), last[by[i] : by[i + 1]].tolist(), strict=True):
                            base = chars[bounds[i]]
                            spans[i].append({"start": int(chars[starts[a]] - base), "stop": int(chars[ends[b - 1]] - base), "marginal": float(one[a:b].mean())})
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(value), pa.array(spans, pa.list_(SPAN))], ["doc_id", "score", "spans"])

    out = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,stop:long,marginal:double>>")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def tag(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS, learn_chars: int = LEARN_CHARS) -> DataFrame:
    """score() of docs by a field learned from them and their labels."""
    return score(docs, learn(docs, labels, per_class, learn_chars), threshold)
