"""Quality rules whose cutoffs are certified on labelled holdouts by exact binomial bounds.

Each text is counted once; rules compare a ratio of counts with a cutoff, in each
stratum. A third of the labelled texts (by their hash) chooses: step by step, the
rule and cutoff that part the texts best that earlier steps left, until none helps.
The other two thirds certify: a step is taken while the exact binomial probability
of so few false rejections by all steps so far, were the chance of one above
`risk`, stays within the error level. Testing in a fixed order that stops at the
first failure needs no correction; levels are shared out over the strata that chose
any step (Bonferroni), which the certifying texts had no part in. So with
probability 1 - delta no stratum rejects more than `risk` of its good texts by all
its rules together.

Trials are distinct texts: copies of a text count once, and all fall to one third.

Defined results: a null text has no words; rows of null lang, or of a lang that is
no stratum, form one more stratum; repeated labels of a document count once, as
bad if any is bad, and so do labels of equal texts; null labels don't count; without labels only the base rules
hold; an empty table gives an empty one; equal rows give equal rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, steps, stored
from .text import BLANK, sums, word_bounds

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"!?=_~^\\{}[]")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


@dataclass(frozen=True)
class Rule:
    """Rejects where numerator / denominator exceeds a cutoff; cutoffs are multiples of `top / BINS`."""

    name: str
    numerator: str
    denominator: str
    top: float


#: Cutoffs that a rule may have.
BINS = 100
RULES = (
    Rule("symbols", "n_symbols", "n_words", 2.0),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1.0),
    Rule("repeats", "n_repeat_words", "n_words", 1.0),
    Rule("upper", "n_upper", "word_chars", 1.0),
    Rule("marks", "n_marks", "n_words", 2.0),
)
STRATA = ("en", "de", "fr", "es")


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    ids = np.fromiter(map({}.setdefault, words, itertools.count()), np.int64, n)
    if n < 1 << 21:
        keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]  # under n^2 < 2^63 for texts of any size in memory
        keys = pairs[:-1] * n + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    found = np.zeros(n - 2, bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    inside[:-2] |= found
    inside[1:-1] |= found
    inside[2:] |= found
    return int(inside.sum())


def count_texts(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text."""
    data, bounds = as_bytes(texts)
    blank = BLANK[data]
    _, _, words_at = word_bounds(~blank, bounds)
    lines, dups, repeats = [], [], []
    for text in texts.cast(pa.binary()).to_pylist():
        full = [x for x in text.split(b"\n") if x.strip()]
        lines.append(len(full))
        dups.append(len(full) - len(set(full)))
        repeats.append(repeat_words(text.split()))
    letters = ~blank & (data & 0xC0 != 0x80)
    found = [np.diff(words_at), sums(letters, bounds), sums(SYMBOLS[data], bounds), dups, repeats, lines, sums(UPPER[data], bounds), sums(MARKS[data], bounds)]
    return [np.asarray(x, np.int64) for x in found]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", strata: Sequence[str] = STRATA) -> DataFrame:
    """doc_id, stratum, text_key (a hash of the text) and COUNTS of each row's whole text."""
    lang = F.col(stratum_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.when(lang.isin(*strata), lang).otherwise("other").alias("stratum")).withColumn("text_key", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                yield pa.RecordBatch.from_arrays([step.column(0), step.column(2), step.column(3), *(pa.array(x, pa.int64()) for x in count_texts(step.column(1)))], ["doc_id", "stratum", "text_key", *COUNTS])

    return rows.mapInArrow(run, "doc_id long, stratum string, text_key long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Binomial(n, p), exact: the regularised incomplete beta function I(1-p; n-k, k+1) by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _fraction(b, a, 1.0 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's method for the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    value = d
    for m in range(1, 1_000_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return value


def certified(rejected: np.ndarray, n: int, risk: float, level: float) -> int:
    """How many steps are certified, in order. rejected[j]: good ones of n that the first j + 1 steps reject."""
    done = 0
    while done < len(rejected) and n and binomial_tail(int(rejected[done]), n, risk) <= level:
        done += 1
    return done


def _bin(rule: Rule) -> Column:
    ratio = F.col(rule.numerator) / F.greatest(F.col(rule.denominator), F.lit(1))
    return F.least(F.ceil(ratio * (BINS / rule.top)), F.lit(BINS)).cast("int")


#: (rule's name, cutoff's index): a step rejects texts whose ratio exceeds index * top / BINS.
Step = tuple[str, int]


def _first_step(paths: dict[str, list[Step]]) -> Column:
    """The number of the first step that rejects a row (stratum, and each rule's bin as `bin_` and its name); null if none does."""
    found = F.lit(None).cast("int")
    for stratum, path in paths.items():
        for j, (name, at) in reversed(list(enumerate(path))):
            found = F.when((F.col("stratum") == stratum) & (F.col(f"bin_{name}") > at), j).otherwise(found)
    return found


def choose(rows: DataFrame, cost: float, rules: Sequence[Rule], strata: Sequence[str]) -> dict[str, list[Step]]:
    """Steps of each stratum that help on rows (stratum, good, bins), best first. One aggregation for all strata's next steps."""
    paths: dict[str, list[Step]] = {s: [] for s in strata}
    growing = set(strata)
    bins = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"bin_{r.name}").alias("bin")) for r in rules]))
    while growing:
        left = rows.where(_first_step(paths).isNull() & F.col("stratum").isin(*sorted(growing)))
        seen = {(s, r.name): np.zeros((2, BINS + 1), np.int64) for s in growing for r in rules}
        for row in left.select("stratum", "good", bins.alias("x")).groupBy("stratum", "good", "x.rule", "x.bin").count().collect():  # strata x rules x bins x 2 rows at most
            seen[row.stratum, row.rule][int(row.good), row.bin] = row["count"]
        for stratum in sorted(growing):
            best = (0.0, 0, "")
            for r in rules:
                n = seen[stratum, r.name]
                above = n.sum(axis=1, keepdims=True) - n.cumsum(axis=1)  # in bins over i
                gain = above[0, :BINS] - cost * above[1, :BINS]
                at = int(np.flatnonzero(gain == gain.max())[-1])
                best = max(best, (float(gain[at]), at, r.name))
            if best[0] > 0:
                paths[stratum].append((best[2], best[1]))  # each step rejects some text that is left: there is a last one
            if best[0] <= 0 or len(paths[stratum]) == 4 * len(rules):
                growing.discard(stratum)
    return paths


def learn(counted: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, cost: float = 20.0, rules: Sequence[Rule] = RULES, strata: Sequence[str] = STRATA) -> dict[tuple[str, str], int]:
    """(stratum, rule) -> cutoff's index. cost: rejected bad texts that weigh up a rejected good one in the choosing third."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = counted.where(~base_failed()).select("doc_id", "stratum", "text_key", *[_bin(r).alias(f"bin_{r.name}") for r in rules]).join(marked, "doc_id")
    rows = rows.groupBy("stratum", "text_key").agg((F.min("quality") == 1).alias("good"), *[F.first(f"bin_{r.name}").alias(f"bin_{r.name}") for r in rules])
    rows = stored(rows.withColumn("holdout", F.pmod("text_key", F.lit(3)) != 0), "labelled")
    paths = choose(rows.where("not holdout"), cost, rules, (*strata, "other"))
    counts_ = rows.where("holdout and good").groupBy("stratum", _first_step(paths).alias("step")).count().collect()  # strata x steps rows
    cutoffs: dict[tuple[str, str], int] = {}
    tested = sum(1 for path in paths.values() if path)
    for stratum, path in paths.items():
        own = {r.step: r["count"] for r in counts_ if r.stratum == stratum}
        rejected = np.cumsum([own.get(j, 0) for j in range(len(path))])
        for name, at in path[: certified(rejected, sum(own.values()), risk, delta / max(1, tested))]:
            cutoffs[stratum, name] = min(at, cutoffs.get((stratum, name), BINS))
    return cutoffs


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, rules: Sequence[Rule] = RULES, strata: Sequence[str] = STRATA) -> DataFrame:
    """doc_id, COUNTS, base_failed, stratum, failed_rules (names, comma-joined), kept of each row of docs (doc_id, text, lang)."""
    counted = stored(counts(docs, strata=strata), "counts")
    cutoffs = learn(counted, labels, risk, delta, rules=rules, strata=strata)
    failed = F.concat_ws(",", F.lit(None).cast("string"), *[F.when(F.coalesce(*[F.when(F.col("stratum") == s, _bin(r) > at) for (s, name), at in cutoffs.items() if name == r.name], F.lit(False)), F.lit(r.name)) for r in rules])
    out = counted.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).select("doc_id", *COUNTS[:5], "base_failed", "kept", "stratum", "failed_rules")
