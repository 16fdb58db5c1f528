"""Near copies by SimHash: fingerprints of WORDS words of 64 bits, compared tile by tile, and links verified by exact Jaccard similarity.

A text's shingles of five words (fewer words: the whole sequence) are a set of 64-bit
hashes; texts of equal sets are one node. A bit of a node's fingerprint is set where
more than half of the set's hashes, mixed anew for each word, set it. Sets of a
similarity s differ by a factor of s at most in size, so that only tiles of near sizes
meet; within those every pair is compared. The nodes that the pairs within RADIUS bits
connect in a pair of tiles are a block, and are compared by their whole sets and linked
from the wanted similarity on.

At a similarity of 0.8 two bits differ with chance 0.152 in large sets and 0.188 at
most (four shingles of five): more than 80 of 256 then differ with chance 5e-7, more
than 48 of the first 128, which are looked at first, with chance 2e-7 (binomial, by
calculation; bits taken as independent). Unlike texts pass both with chance 1e-9.
Comparing grows with the square of the distinct sets of near sizes.

Defined results: as of minhash.near_copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, steps, stored
from .minhash import SIMILARITY, WORDS, node_of, rooted_copies, shingles, verified
from .simhash import majority_bits

#: 64-bit words of a fingerprint, and how many bits of all, and of the first two, may differ.
PARTS, RADIUS, FIRST_RADIUS = 4, 80, 48
#: Nodes in a tile, about.
TILE = 2048
#: Classes of sizes that a factor of the similarity spans.
CLASSES = 4
#: Tiles of a class that meet others together.
GROUP = 16
_STEPS = np.arange(PARTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fingerprint(found: np.ndarray) -> list[int]:
    """A set's fingerprint as PARTS signed words, each by hashes mixed anew."""
    x = found[None, :] + _STEPS[:, None]
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.array([majority_bits(part) for part in x], np.uint64).view(np.int64).tolist()


def _prints(docs: DataFrame, words_each: int) -> DataFrame:
    """doc_id, text_key, node, n (shingles of its set), fp (none for a text without words) of rows doc_id, text, text_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                sets = [shingles(t, words_each) for t in part.column(1).cast(pa.binary()).to_pylist()]
                fps = pa.array([fingerprint(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), fps], ["doc_id", "text_key", "node", "n", "fp"])

    return docs.mapInArrow(run, "doc_id long, text_key long, node long, n long, fp array<long>")


def _near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within both radii."""
    found = []
    for k in range(0, len(x), 128):
        some = x[k : k + 128]
        bits = np.bitwise_count(some[:, None, 0] ^ y[None, :, 0])
        bits += np.bitwise_count(some[:, None, 1] ^ y[None, :, 1])
        i, j = np.nonzero(bits <= FIRST_RADIUS)
        near = np.bitwise_count(some[i] ^ y[j]).sum(axis=1, dtype=np.int64) <= RADIUS
        found.append((i[near] + k, j[near]))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def _blocks(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """The nodes, in order, of each component of more than one that edges between places connect."""
    i, j = i[nodes[i] != nodes[j]], j[nodes[i] != nodes[j]]
    if not len(i):
        return []
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    met = np.unique(np.concatenate([i, j]))
    met = met[np.lexsort((nodes[met], label[met]))]
    return np.split(nodes[met], np.flatnonzero(np.diff(label[met])) + 1)


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """x: sorted lists of nodes (columns node, n, fp) that hold every pair whose fingerprints are near."""
    width = -log(similarity) * 1.0001 / CLASSES  # a little wide, so that rounding loses no pair
    keyed = nodes.where("n > 0").select("node", "fp", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).alias("class"))
    # As many rows as there are classes: some hundreds, whatever the input's size.
    sizes = F.broadcast(keyed.groupBy("class").agg(F.ceil(F.count("*") / TILE).alias("tiles")))
    placed = keyed.join(sizes, "class").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    tiles = stored(placed.groupBy("class", "tile").agg(F.collect_list(F.struct("node", "fp")).alias("all")).select("class", "tile", F.col("all.node").alias("nodes"), F.flatten("all.fp").alias("fps")), "tiles")
    groups = F.broadcast(tiles.groupBy("class").agg(F.floor(F.max("tile") / GROUP).alias("last")))
    left = tiles.select(F.col("class").alias("own"), F.col("tile").alias("own_tile"), F.col("nodes").alias("x"), F.col("fps").alias("xf"), F.explode(F.array(*map(F.lit, range(CLASSES + 1)))).alias("shift")).withColumn("class", F.col("own") + F.col("shift"))
    left = left.join(groups, "class").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    right = tiles.select("class", "tile", F.floor(F.col("tile") / GROUP).alias("group"), F.col("nodes").alias("y"), F.col("fps").alias("yf"))
    pairs = left.join(right, ["class", "group"]).where("shift <> 0 or own_tile <= tile").select("x", "xf", "y", "yf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, xf, y, yf = (np.asarray(batch.column(c)[row].values) for c in range(4))
                i, j = _near(xf.view(np.uint64).reshape(-1, PARTS), yf.view(np.uint64).reshape(-1, PARTS))
                both, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                found = _blocks(both, at[i], at[len(x) + j])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["x"])

    return pairs.mapInArrow(run, "x array<long>")


def near_copies(docs: DataFrame, words_each: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text), component_id, component_key of each row: the first (doc_id, text_key) reachable over links, null ids last."""
    rows = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    prints = stored(_prints(rows, words_each), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = stored(prints.groupBy("node").agg(F.min(first).alias("low"), F.first("n").alias("n"), F.first("fp").alias("fp")), "nodes")
    return rooted_copies(prints, nodes, verified(candidates(nodes, similarity), nodes, rows, words_each, similarity))
