"""Near copies by exact Jaccard similarity of word shingles, candidates by MinHash bands.

A text's shingles of five words (fewer words: the whole sequence) are a set of 64-bit
hashes. Texts of equal sets are one node. A node has BANDS keys of ROWS minima each;
two sets of Jaccard similarity s share no key with chance (1 - s^ROWS)^BANDS, which
is 5e-8 at 0.8. Nodes that share a key are compared by their whole sets, in blocks,
and linked from the wanted similarity on. Each block passes on a spanning forest, and
blocks of the same nodes, found by several keys, are compared once.

Defined results: a null text is an empty one; texts without words are equal; a null
doc_id gets the smallest non-null doc_id of its component; rows of one id but unlike
texts are told apart by the hash of the text; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, steps, stored
from .components import star_forest
from .simhash import shingle_hashes

WORDS, SIMILARITY = 5, 0.8
NO_ID = -(1 << 63)
BANDS, ROWS = 32, 4
#: Nodes of a block's side.
TILE = 256
_RNG = np.random.default_rng(20240307)
FLIP, ODD = (_RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
ODD |= np.uint64(1)


def shingles(text: bytes, words_each: int = WORDS) -> np.ndarray:
    """The set of the text's shingles, in order."""
    return np.unique(shingle_hashes(text, words_each))


def band_keys(found: np.ndarray) -> list[int]:
    """A signed key for each band of a set that isn't empty."""
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(found), 4096):
        np.minimum(low, ((found[None, k : k + 4096] ^ FLIP[:, None]) * ODD[:, None]).min(axis=1), out=low)
    data, n = low.tobytes(), 8 * ROWS
    keys = [xxhash.xxh3_64_intdigest(data[n * b : n * b + n], b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def node_of(found: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(found.tobytes()), "big", signed=True)


def _sketches(docs: DataFrame, words_each: int) -> DataFrame:
    """doc_id, text_key, node, keys (none for a text without words) of rows doc_id, text, text_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                sets = [shingles(t, words_each) for t in part.column(1).cast(pa.binary()).to_pylist()]
                keys = pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(map(node_of, sets), pa.int64()), keys], ["doc_id", "text_key", "node", "keys"])

    return docs.mapInArrow(run, "doc_id long, text_key long, node long, keys array<long>")


def _sets(docs: DataFrame, words_each: int) -> DataFrame:
    """node, found: the whole set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                sets = [shingles(t, words_each) for t in part.column(0).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "found"])

    return docs.select("text").mapInArrow(run, "node long, found array<long>")


def _forest(nodes: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that connect what links between the sets connect. A set is compared with a group's members until one links."""
    groups: list[list[int]] = []
    edges, share = [], similarity / (1 + similarity)
    for k, own in enumerate(sets):
        joined, apart = [k], []
        for group in groups:
            for j in group:
                n = len(own) + len(sets[j])
                if min(len(own), len(sets[j])) >= share * n - 1e-9 and len(np.intersect1d(own, sets[j], assume_unique=True)) >= share * n - 1e-9:
                    edges.append((nodes[k], nodes[j]))
                    joined += group
                    break
            else:
                apart.append(group)
        groups = [*apart, joined]
    return edges


def links(nodes: DataFrame, docs: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """a, b: edges between nodes (columns node, low, keys) that connect what links of the similarity connect."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / TILE).alias("tiles")), "shared")
    lists = keyed.join(shared, "key").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles")).groupBy("key", "tiles", "tile").agg(F.array_sort(F.collect_list("node")).alias("x"))
    lists = stored(lists, "lists")
    large = lists.where("tiles > 1")
    other = large.select("key", F.col("tile").alias("tile2"), F.col("x").alias("y"))
    crossed = large.join(other, "key").where("tile < tile2").select(F.concat("x", "y").alias("x"))
    return verified(lists.where("size(x) > 1").select("x").union(crossed), nodes, docs, words_each, similarity)


def verified(blocks: DataFrame, nodes: DataFrame, docs: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """a, b: edges that connect what links of the similarity within lists x of nodes connect."""
    asked = stored(blocks.distinct().select(F.xxhash64("x").alias("block"), F.explode("x").alias("node")), "asked")
    wanted = stored(asked.select("node").distinct(), "wanted")
    # One set a node: its first row's text has it. Should an id be NO_ID, more texts may be read than needed.
    ids = nodes.join(wanted, "node").select(F.coalesce("low.doc_id", F.lit(NO_ID)).alias("own"), F.col("low.text_key").alias("text_key")).distinct()
    sets = _sets(docs.withColumn("own", F.coalesce("doc_id", F.lit(NO_ID))).join(ids, ["own", "text_key"], "left_semi"), words_each)
    sets = stored(sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("found").alias("found")), "sets")

    def compare(block: pa.Table) -> pa.Table:
        lists = block.column("found").combine_chunks()
        ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
        edges = _forest(block.column("node").to_pylist(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], similarity)
        return pa.table([pa.array([e[side] for e in edges], pa.int64()) for side in (0, 1)], ["a", "b"])

    return asked.join(sets, "node").groupBy("block").applyInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, words_each: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text), component_id, component_key of each row: the first (doc_id, text_key) reachable over links, null ids last."""
    rows = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    prints = stored(_sketches(rows, words_each), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = stored(prints.groupBy("node").agg(F.min(first).alias("low"), F.first("keys").alias("keys")), "nodes")
    return rooted_copies(prints, nodes, links(nodes, rows, words_each, similarity))


def rooted_copies(prints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What near_copies returns, by the edges between its nodes."""
    forest = star_forest(edges)
    rooted = nodes.join(forest.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    lows = stored(rooted.groupBy("root").agg(F.min("low").alias("first")), "lows")
    named = stored(rooted.join(lows, "root").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("component_key")), "named")
    return prints.select("doc_id", "text_key", "node").join(named, "node").select("doc_id", "text_key", "component_id", "component_key")
