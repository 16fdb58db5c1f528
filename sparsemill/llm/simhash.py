"""SimHash fingerprints, and their links within a Hamming radius by exact tiled comparison.

Each text's 3-word shingles (fewer words: the whole sequence) are hashed by XXH64
with seed 42; a bit of the fingerprint is set where more than half of the hashes
set it. Distinct fingerprints are laid out in tiles by the population counts of
their four 16-bit quarters. Two fingerprints that differ in at most r bits have
quarter counts that differ by at most r in sum, so only tiles whose counts are
that near meet; the others are skipped. A pair of tiles is compared in full by
numpy's exclusive-or and bit counts, and passes on a spanning forest of the links
it found: the forests of all pairs connect what the links connect. Comparing grows
with the square of the distinct fingerprints, of whose pairs about one in 160 meets.

Defined results: a null text is an empty one; a text without words has the
fingerprint zero, linked like any other; equal rows give equal rows; a null
doc_id gets a fingerprint and the smallest non-null doc_id of its component; an
empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, steps, stored
from .components import star_forest

#: Fingerprints in a tile, about.
TILE = 2048
#: Tiles of one count vector that meet others together; a full count vector is shared out by such groups.
GROUP = 16
QUARTERS = 4


def shingle_hashes(text: bytes, words_each: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text, repeats included."""
    words = text.lower().split()  # on bytes: ASCII letters and white space only, as wanted
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cut = map(line.__getitem__, map(slice, starts[: 1 - words_each].tolist(), ends[words_each - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, itertools.repeat(seed)), np.uint64, len(words) - words_each + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in over half of the hashes."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    if n == 0:
        return 0
    ones = np.uint64(0x0101010101010101)
    padded = np.zeros((-(-n // 255), 255), np.uint64)
    padded.reshape(-1)[:n] = hashes
    for bit in range(8):  # each byte of the sum counts one bit position of 255 hashes at most
        sums = ((padded >> np.uint64(bit)) & ones).sum(axis=1, dtype=np.uint64)
        counts[bit::8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: each whole text's fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                found = [majority_bits(shingle_hashes(t)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _near_counts(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts whose sum is within the radius, the first non-zero one positive, or none."""
    every = itertools.product(range(-radius, radius + 1), repeat=QUARTERS)
    return [d for d in every if sum(map(abs, d)) <= radius and (next((x for x in d if x), 0) >= 0)]


def _forest(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within the radius between x and y connect."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    i_all, j_all = [], []
    for k in range(0, len(x), 256):
        i, j = np.nonzero(np.bitwise_count(x[k : k + 256, None] ^ y[None, :]) <= radius)
        i_all.append(at[i + k])
        j_all.append(at[j + len(x)])
    i, j = np.concatenate(i_all), np.concatenate(j_all)
    i, j = i[i != j], j[i != j]
    if len(i) == 0:
        return nodes[:0], nodes[:0]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            hung = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[hung], nodes[label[hung]]
        label = new


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: edges between distinct fingerprints (column fp) that connect exactly what links within the radius connect."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(0xFFFF)).cast("int") for q in range(QUARTERS)]
    base = 17 + 2 * radius  # a count and its differences in one digit
    spread = [base**q for q in range(QUARTERS)]
    keyed = distinct.select("fp", sum((c + F.lit(radius)) * F.lit(s) for c, s in zip(quarter, spread, strict=True)).alias("counts"))
    # As many rows as there are count vectors: 17^4 at most, whatever the input's size.
    sizes = F.broadcast(keyed.groupBy("counts").agg(F.ceil(F.count("*") / TILE).alias("tiles")))
    placed = keyed.join(sizes, "counts").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    tiles = stored(placed.groupBy("counts", "tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    shifts = [sum(d * s for d, s in zip(x, spread, strict=True)) for x in _near_counts(radius)]
    groups = F.broadcast(tiles.groupBy("counts").agg(F.floor(F.max("tile") / GROUP).alias("last")))
    left = tiles.select(F.col("counts").alias("own"), F.col("tile").alias("own_tile"), F.col("fps").alias("x"), F.explode(F.array(*map(F.lit, shifts))).alias("shift")).withColumn("counts", F.col("own") + F.col("shift"))
    left = left.join(groups, "counts").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    right = tiles.select("counts", "tile", F.floor(F.col("tile") / GROUP).alias("group"), F.col("fps").alias("y"))
    pairs = left.join(right, ["counts", "group"]).where("shift <> 0 or own_tile <= tile").select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            (xs, ys) = batch.column(0), batch.column(1)
            xo, yo = np.asarray(xs.offsets), np.asarray(ys.offsets)
            xv, yv = np.asarray(xs.values).view(np.uint64), np.asarray(ys.values).view(np.uint64)
            for k in range(batch.num_rows):
                one, other = _forest(xv[xo[k] : xo[k + 1]], yv[yo[k] : yo[k + 1]], radius)
                if len(one):
                    a.append(one)
                    b.append(other)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) of rows of fingerprints()."""
    prints = stored(prints, "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    forest = star_forest(links(distinct, radius))
    rooted = distinct.join(forest.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    lows = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    named = stored(rooted.join(lows, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of each row."""
    found = components(fingerprints(docs, id_col, text_col), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
