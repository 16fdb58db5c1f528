"""Nearest neighbours by cross-polytope hashing with several probes, reranked exactly.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform.
After it, a unit vector's hash is its nearest signed axis. A bucket of a table is
named by several such hashes. A query probes, of all buckets, the part that is
jointly nearest to it: a bucket's loss is the sum over its hashes of the squared
gap between the query's greatest component and the one along the bucket's axis,
and the greatest loss that is probed follows from the distribution of these sums
(a convolution of the hashes' own), so that no list of buckets is made.

One rule sets both numbers for tables of every size: n vectors have
2 + log2(n) / 4 hashes a table, rounded up, and PROBED / cbrt(n) of a table's buckets
are probed. So the compared part of the table falls as the table grows.

Every distinct vector travels once for each table, as it is given (floats stay
floats), with its hashes there; equal vectors are one, with as many of their
smallest ids as an answer can hold. Tables are dealt by their leading hashes (as
many as it takes), and by rows where that leaves too much for a task: a bucket of
any size is shared out. A block compares its rows that fall into probed buckets
with each query, in double precision, and passes on the nearest few; no pairs are
emitted, and no candidate is left out.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, as query or candidate, and so have no result rows; rows
of null ids neither; a query with fewer candidates than k gets all of them; one whose
probed buckets hold fewer than that is compared with all rows of its length;
vectors are only compared with others of their length; rows that repeat an id and
a vector count once; an id with several vectors is as near as the nearest of them;
an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

TABLES = 3
#: Times 1 / cbrt(n): the part of a table's buckets that is probed.
PROBED = 0.6
#: Rows of a block, or more for large tables, and queries that meet it at a time.
BLOCK, ASKS = 32_768, 1024
#: The sizes of so many leading buckets (32 bytes each) are broadcast; more are joined.
FEW = 1 << 20
#: Steps in which losses are summed up to find the greatest one that is probed.
BINS = 2048


def hashes_for(n: int) -> int:
    """Hashes a table of n vectors."""
    return 2 + math.ceil(math.log2(max(n, 2)) / 4)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform, of rows whose length is a power of two."""
    n, signs = x.shape[1], np.random.default_rng(seed)
    y = np.ascontiguousarray(x.T)  # a row for each component: every step adds long rows
    for _ in range(3):
        y = y * signs.choice([-1.0, 1.0], n).astype(y.dtype)[:, None]
        h = 1
        while h < n:
            z = y.reshape(-1, 2, h, y.shape[1])
            y = np.stack([z[:, 0] + z[:, 1], z[:, 0] - z[:, 1]], axis=1).reshape(n, -1)
            h *= 2
        y /= np.sqrt(n).astype(y.dtype)
    return y.T


def padded(x: np.ndarray) -> np.ndarray:
    """Unit vectors, filled up with zeros to a power of two."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, n - x.shape[1])))


def axes(x: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: 2 * axis, and 1 more for the negative one."""
    at = np.abs(x).argmax(axis=1)
    return 2 * at + (x[np.arange(len(x)), at] < 0)


def _seed(dim: int, table: int, k: int) -> int:
    return (dim * 1024 + table) * 64 + k


def codes(x: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """The hashes of each row in every table."""
    out = np.empty((len(x), tables * hashes), np.int32)
    for at in range(0, len(x), 1024):
        unit = padded(x[at : at + 1024].astype(np.float64)).astype(np.float32)
        for t in range(tables):
            for k in range(hashes):
                out[at : at + 1024, t * hashes + k] = axes(rotate(unit, _seed(x.shape[1], t, k)))
    return out


def losses(x: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """For each row, hash and signed axis: the squared gap to the row's greatest component."""
    unit = padded(x.astype(np.float64)).astype(np.float32)
    out = []
    for k in range(hashes):
        r = rotate(unit, _seed(x.shape[1], table, k))
        signed = np.stack([r, -r], axis=2).reshape(len(r), -1)
        out.append((signed.max(axis=1, keepdims=True) - signed) ** 2)
    return np.stack(out, axis=1)


def reach(lost: np.ndarray, part: float) -> np.ndarray:
    """The greatest sum of losses of the nearest `part` of all buckets, for each row of losses()."""
    q, hashes, n = lost.shape
    if part >= 1:
        return np.full(q, np.inf, np.float32)
    step = lost.max(axis=2).sum(axis=1) / (BINS - hashes)
    product = np.ones((q, BINS // 2 + 1), complex)
    row = np.repeat(np.arange(q), n) * BINS
    for k in range(hashes):
        at = (lost[:, k] / step[:, None]).astype(np.int64).ravel()
        product *= np.fft.rfft(np.bincount(row + at, minlength=q * BINS).reshape(q, BINS) / n, axis=1)
    below = np.cumsum(np.fft.irfft(product, BINS, axis=1), axis=1)
    return ((np.argmax(below >= part, axis=1) + 0.5 * (hashes + 1)) * step).astype(np.float32)


def prefixes(lost: np.ndarray, most: float, depth: int) -> np.ndarray:
    """Numbers of the first `depth` hashes of a query's probed buckets. lost: of one row."""
    number, total = np.zeros(1, np.int64), np.zeros(1, np.float32)
    for k in range(depth):
        sums = total[:, None] + lost[k]
        near = sums <= most
        number = (number[:, None] * lost.shape[1] + np.arange(lost.shape[1]))[near]
        total = sums[near]
    return number


def _depth(dim: int, n: int, block: int, hashes: int) -> int:
    """How many leading hashes a table is dealt by."""
    signed = 2 << max(1, (dim - 1).bit_length())
    return max(0, min(hashes, int(math.log(max(1.0, n / block)) / math.log(signed))))


def _good(lists: pa.Array) -> np.ndarray:
    """Which vectors take part."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    ends = np.concatenate([[0], np.cumsum(size)])
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[ends])
    return (count(~np.isfinite(x)) == 0) & (count(x != 0) > 0)


def _coded(vectors: DataFrame, is_query: Column, n: int, block: int, tables: int, hashes: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, asks, dim, u, w (a digest of the vector), v, codes, prefixes (a number in each table) of each row that takes part."""
    element = vectors.schema[vector_col].dataType.elementType
    kind, number = ("float", pa.float32()) if isinstance(element, T.FloatType) else ("double", pa.float64())
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where("vec_id is not null and v is not null")
    names = ["vec_id", "asks", "dim", "u", "w", "v", "codes", "prefixes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_good(batch.column(2))))
            lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dim))
                m = own.num_rows
                x = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(m, dim) + number.to_pandas_dtype()(0)  # no negative zeros
                code = codes(x, tables, hashes)
                depth, signed = _depth(dim, n, block, hashes), 2 << max(1, (dim - 1).bit_length())
                lead = np.zeros((m, tables), np.int64)
                for k in range(depth):
                    lead = lead * signed + code[:, k::hashes]
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r) for r in x), ">i8").reshape(m, 2).astype(np.int64)
                lists = lambda a, width: pa.ListArray.from_arrays(np.arange(0, m * width + 1, width, dtype=np.int32), pa.array(np.ascontiguousarray(a).ravel()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(m, dim, np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists(x, dim), lists(code.astype(np.int16) if signed < 1 << 15 else code, tables * hashes).cast(pa.list_(pa.int32())), lists(lead, tables)], names)

    return rows.mapInArrow(run, f"vec_id long, asks boolean, dim int, u long, w long, v array<{kind}>, codes array<int>, prefixes array<long>")


def _index(coded: DataFrame, keep: int) -> DataFrame:
    """dim, u, v, codes, prefixes, ids: each distinct vector with its `keep` smallest ids in order. Only rows of vectors that repeat are moved."""
    many = stored(coded.groupBy("u", "w").agg(F.count("*").alias("n")).where("n > 1").select("u", "w"), "repeated")
    copies = coded.join(many, ["u", "w"], "left_semi")
    ranked = copies.select("u", "w", "vec_id").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("u", "w").orderBy("vec_id"))).where(F.col("rank") <= keep)
    ids = ranked.groupBy("u", "w").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    once = copies.groupBy("u", "w").agg(*[F.first(c).alias(c) for c in ("dim", "v", "codes", "prefixes")]).join(ids, ["u", "w"])
    alone = coded.join(many, ["u", "w"], "left_anti").withColumn("ids", F.array("vec_id"))
    return alone.select("dim", "u", "v", "codes", "prefixes", "ids").union(once.select("dim", "u", "v", "codes", "prefixes", "ids"))


def _search(index: DataFrame, asked: DataFrame, tables: int, k: int, block: int, hashes: int, part: float, depth_of) -> DataFrame:  # noqa: ANN001
    """query_id, far, vec_id: the nearest k or more (with ties) of each block that a query meets. index: dim, u, v, ids, tab (from 0), prefix, codes of that table; asked: dim, u, v, ids."""
    kind = index.schema["v"].dataType.elementType.simpleString()
    key = ["dim", "tab", "prefix"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "tab", "prefix", "reach", "u", "v", "ids"]
        for batch in batches:
            both = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for dim, tab in sorted(set(both)):
                own = batch.filter(pa.array([x == (dim, tab) for x in both]))
                x = own.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                lost = losses(x, tab, hashes)
                most = reach(lost, part)
                for j in range(own.num_rows):
                    lead = prefixes(lost[j], most[j], depth_of(dim))
                    m = len(lead)
                    one = own.take(pa.array(np.full(m, j)))
                    yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array(lead), pa.array(np.full(m, most[j], np.float32)), *(one.column(i) for i in (2, 3, 4))], names)

    probes = stored(asked.select("dim", F.explode(F.array(*map(F.lit, range(tables)))).alias("tab"), "u", "v", "ids").mapInArrow(probe, f"dim int, tab int, prefix long, reach float, u long, v array<{kind}>, ids array<long>"), "probes")
    met = probes.groupBy(key).agg(F.ceil(F.count("*") / ASKS).cast("int").alias("asks"))
    sizes = stored(index.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("rows")).join(met, key), "sizes")
    if sizes.count() <= FEW:
        sizes = F.broadcast(sizes)
    deal = lambda n: F.pmod(F.xxhash64("u", F.lit(7)), F.col(n)).cast("int")
    left = probes.join(sizes, key).withColumn("ask", deal("asks")).select(*key, "ask", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "reach", "v", "ids")
    right = index.join(sizes, key).withColumn("row", deal("rows")).select(*key, F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), "row", "codes", "v", "ids")

    def compare(asks: pa.Table, there: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if asks.num_rows and there.num_rows:
            dim, tab = asks.column("dim")[0].as_py(), asks.column("tab")[0].as_py()
            flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            x, q = flat(there, "v").reshape(-1, dim), flat(asks, "v").reshape(-1, dim).astype(np.float64)
            code = np.ascontiguousarray(flat(there, "codes").reshape(len(x), hashes).T).astype(np.intp)
            lists = there.column("ids").combine_chunks()
            size, ids = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(size)])
            most = flat_reach = asks.column("reach").to_numpy()
            for at in range(0, len(q), 64):
                lost = losses(q[at : at + 64], tab, hashes) if np.isfinite(flat_reach[at : at + 64]).any() else None
                for j in range(at, min(at + 64, len(q))):
                    if np.isfinite(most[j]):
                        total = lost[j - at, 0][code[0]]
                        for i in range(1, hashes):
                            total += lost[j - at, i][code[i]]
                        near = np.flatnonzero(total <= most[j])
                    else:
                        near = np.arange(len(x))
                    if not len(near):
                        continue
                    far = np.sqrt(((x[near] - q[j]) ** 2).sum(axis=1))
                    if len(near) > k + 1:  # with ties, k + 1 distinct vectors hold any query's answer
                        bound = np.partition(far, k)[k]
                        near, far = near[far <= bound], far[far <= bound]
                    found[0].append(j)
                    found[1].append(np.concatenate([ids[first[i] : first[i + 1]] for i in near.tolist()]))
                    found[2].append(np.repeat(far, size[near]))
        asked_ids = asks.column("ids").combine_chunks().take(pa.array(found[0], pa.int64())) if found[0] else pa.array([], pa.list_(pa.int64()))
        return pa.table([asked_ids, pa.array(found[1], pa.list_(pa.int64())), pa.array(found[2], pa.list_(pa.float64()))], ["asked", "ids", "far"])

    blocks = left.groupBy(*key, "ask", "row").cogroup(right.groupBy(*key, "ask", "row")).applyInArrow(compare, "asked array<long>, ids array<long>, far array<double>")
    each = blocks.select(F.explode("asked").alias("query_id"), "ids", "far").select("query_id", F.explode(F.arrays_zip("far", "ids")).alias("x"))
    return each.select("query_id", F.col("x.far").alias("far"), F.col("x.ids").alias("vec_id")).where("vec_id <> query_id")


def _best(each: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, far: the k nearest of all blocks. Spark ranks each partition's rows before it deals them by query."""
    once = each.groupBy("query_id", "vec_id").agg(F.min("far").alias("far"))
    order = Window.partitionBy("query_id").orderBy("far", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "far")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, probed: float = PROBED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest found of each row of the given condition (on columns of `vectors`), itself excepted; ties to the smaller id."""
    n = max(1, vectors.count())
    hashes, part = hashes_for(n), min(1.0, probed / n ** (1 / 3))
    block = max(BLOCK, min(n // 512, 8 * BLOCK))
    coded = stored(_coded(vectors, is_query, n, block, tables, hashes, id_col, vector_col), "vectors")
    index = _index(coded, k + 1)
    # Equal queries share their probes: a query's row holds its vector and the ids of all queries of that vector, in lists of about ASKS at most.
    asked = coded.where("asks").select("dim", "u", "w", "v", "vec_id").withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(n // (100 * ASKS) + 1)))
    asked = stored(asked.groupBy("dim", "u", "w", "g").agg(F.first("v").alias("v"), F.array_distinct(F.collect_list("vec_id")).alias("ids")).select("dim", "u", "v", "ids"), "asked")
    each_table = F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.get("prefixes", F.lit(t)).alias("prefix"), F.slice("codes", t * hashes + 1, hashes).alias("codes")) for t in range(tables)]))
    dealt = index.select("dim", "u", "v", "ids", each_table.alias("x")).select("dim", "u", "v", "ids", "x.*")
    best = stored(_best(_search(dealt, asked, tables, k, block, hashes, part, lambda dim: _depth(dim, n, block, hashes)), k), "best")
    # Exactly, queries that have fewer than k, unless they are compared with all others of their length already.
    own = asked.select("dim", F.explode("ids").alias("vec_id")).groupBy("vec_id").agg(F.collect_set("dim").alias("dims"))
    counted = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("found"))
    short = own.join(counted, "vec_id", "left").where(F.coalesce("found", F.lit(0)) < k).select("vec_id", "dims")
    short = stored(short, "short")
    if not short.isEmpty():
        lengths = short.select(F.explode("dims").alias("dim")).distinct()
        whole = index.join(lengths, "dim", "left_semi").select("dim", "u", "v", "ids", F.lit(0).alias("tab"), F.lit(0).cast("long").alias("prefix"), F.slice("codes", 1, hashes).alias("codes"))
        few = asked.select("dim", "u", "v", F.explode("ids").alias("vec_id")).join(short, "vec_id", "left_semi").select("dim", "u", "v", F.array("vec_id").alias("ids"))
        exact = _best(_search(whole, few, 1, k, block, hashes, 1.0, lambda dim: 0), k)
        best = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(exact)
    return best.select("query_id", "rank", "vec_id", F.col("far").alias("score"))
