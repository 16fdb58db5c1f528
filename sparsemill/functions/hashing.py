"""Seeded 32-bit murmur hashing and hash combination, on the driver, in Arrow batches and as native columns.

Spark's own hash() is murmur3 with the fixed seed 42, chained over its arguments:
the hash of one argument seeds the next. Hashing a 4-byte integer is a bijection
for any seed, so for each wanted seed s there is one integer p with
hash(p) == s, and hash(lit(p), x) is the hash of the integer x seeded with s,
inside whole-stage codegen. Strings whose length isn't a multiple of four differ in
Spark's hash(), so tokens go through numpy in Arrow batches, or through
higher-order functions where a plan must stay native.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

M32 = 0xFFFFFFFF
MASK31 = 0x7FFFFFFF
# murmur3's constants, the FNV prime, the constant feature's hash.
C1, C2, ADD = 0xCC9E2D51, 0x1B873593, 0xE6546B64
MIX1, MIX2 = 0x85EBCA6B, 0xC2B2AE35
FNV_PRIME = 16777619
CONSTANT_HASH = 11650396
# The bytes whose hashes seed a transformed namespace's five kinds of emissions.
SEED_BYTES = (bytes([214, 231, 1, 55]), bytes([255, 6, 14, 69]), bytes([50, 6, 71, 123]), bytes([10, 3, 0, 43]), bytes([0, 53, 10, 201]))


def _rotl(x: int, r: int) -> int:
    return (x << r | x >> (32 - r)) & M32


def _block(k: int) -> int:
    return _rotl(k * C1 & M32, 15) * C2 & M32


def _final(h: int) -> int:
    h = (h ^ h >> 16) * MIX1 & M32
    h = (h ^ h >> 13) * MIX2 & M32
    return h ^ h >> 16


def murmur3(data: bytes, seed: int = 0) -> int:
    """murmur3_x86_32, unsigned."""
    h, whole = seed & M32, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (_rotl(h ^ _block(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + ADD) & M32
    if len(data) > whole:
        h ^= _block(int.from_bytes(data[whole:], "little"))
    return _final(h ^ len(data))


def seeding_integer(seed: int) -> int:
    """The signed integer whose hash, seeded with 42, is the given seed."""
    inverse = lambda c: pow(c, -1, 1 << 32)
    h = seed & M32
    h ^= h >> 16
    h = h * inverse(MIX2) & M32
    h ^= h >> 13 ^ h >> 26
    h = h * inverse(MIX1) & M32
    h ^= h >> 16
    h ^= 4
    h = _rotl((h - ADD) * inverse(5) & M32, 19) ^ 42
    k = _rotl(h * inverse(C2) & M32, 17) * inverse(C1) & M32
    return k - (1 << 32) if k >= 1 << 31 else k


def int_hash(seed: int, *values: Column) -> Column:
    """Hash of 32-bit integers, each seeding the next, the first seeded with `seed`; 31 bits, as a long."""
    return F.hash(F.lit(seeding_integer(seed)), *values).bitwiseAND(F.lit(MASK31)).cast("long")


def namespace_seed(name: str) -> int:
    return murmur3(name.encode())


def token_hash_local(token: str, name: str) -> int:
    return murmur3(token.encode(), namespace_seed(name)) & MASK31


def transform_seeds(index: int) -> list[int]:
    """Seeds of the five kinds of emissions of the index-th transformed namespace."""
    return [murmur3(b, index ^ 1 << 31) for b in SEED_BYTES]


def murmur3_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray | int) -> np.ndarray:
    """murmur3 of each span of some bytes, with a seed for all or for each; unsigned."""
    n, size = len(starts), ends - starts
    if n == 0:
        return np.zeros(0, np.uint32)
    data = np.append(data, np.zeros(8, np.uint8))
    h = np.broadcast_to(np.asarray(seeds, np.uint32), n).copy()
    word = lambda at: data[at].astype(np.uint32) | data[at + 1].astype(np.uint32) << np.uint32(8) | data[at + 2].astype(np.uint32) << np.uint32(16) | data[at + 3].astype(np.uint32) << np.uint32(24)
    rotl = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    mixed = lambda k: rotl(k * np.uint32(C1), 15) * np.uint32(C2)
    left = np.arange(n)
    for block in range(int(size.max()) // 4):
        left = left[size[left] >= 4 * block + 4]
        h[left] = rotl(h[left] ^ mixed(word(starts[left] + 4 * block)), 13) * np.uint32(5) + np.uint32(ADD)
    rest = np.flatnonzero(size % 4)
    if len(rest):
        k = word(starts[rest] + size[rest] // 4 * 4) & ((np.uint32(1) << (np.uint32(8) * (size[rest] % 4).astype(np.uint32))) - np.uint32(1))
        h[rest] ^= mixed(k)
    h ^= size.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(MIX1)
    h = (h ^ h >> np.uint32(13)) * np.uint32(MIX2)
    return h ^ h >> np.uint32(16)


def murmur3_array(tokens: pa.Array, seeds: np.ndarray | int) -> np.ndarray:
    """murmur3 of each string of an Arrow array (nulls as empty), with a seed for all or for each; unsigned."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.uint32)
    tokens = tokens.cast(pa.large_binary())
    ends = np.frombuffer(tokens.buffers()[1], np.int64, n + 1, tokens.offset * 8)
    raw = tokens.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: ends[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return murmur3_spans(data, ends[:-1], ends[1:], seeds)


def token_hash(tokens: Column, seed: int) -> Column:
    """31-bit hashes of an array of strings, as an array of longs, by an Arrow function over whole batches."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(lists: pa.Array) -> pa.Array:
        if pa.types.is_large_list(lists.type):
            lists = lists.cast(pa.list_(lists.type.value_type))
        flat = lists.flatten()
        hashed = pa.array((murmur3_array(flat.fill_null(""), seed) & np.uint32(MASK31)).astype(np.int64))
        lengths = np.where(np.asarray(lists.is_null()), 0, np.diff(np.asarray(lists.offsets)))
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(np.asarray(lists.is_null()), False))
        return pa.ListArray.from_arrays(ends, hashed)

    # Not deterministic, as far as the optimizer knows: else filters that it infers from later steps would repeat the hashing.
    return run.asNondeterministic()(tokens)


def _low_product(x: Column, c: int) -> Column:
    """x * c modulo 2^32 for x < 2^32, without overflow of longs."""
    return ((x.bitwiseAND(F.lit(65535)) * c) + (F.shiftrightunsigned(x, 16) * c).bitwiseAND(F.lit(65535)) * 65536).bitwiseAND(F.lit(M32))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_hash_native(token: Column, seed: int) -> Column:
    """31-bit hash of a string, by higher-order functions only."""
    rotl = lambda x, r: _let(x * (1 << r), lambda y: y.bitwiseAND(F.lit(M32)).bitwiseOR(F.shiftrightunsigned(y, 32)))
    mixed = lambda k: _low_product(rotl(_let(k, lambda x: _low_product(x, C1)), 15), C2)
    fixed = lambda x, s, c: _let(x, lambda y: _let(y.bitwiseXOR(F.shiftrightunsigned(y, s)), lambda z: _low_product(z, c)))
    text = F.hex(token.cast("binary"))
    size = F.octet_length(token)

    def byte(digits: Column, at: Column) -> Column:
        return F.coalesce(F.conv(F.nullif(F.substring(digits, at * 2 + 1, F.lit(2)), F.lit("")), 16, 10).cast("long"), F.lit(0).cast("long"))

    def word(digits: Column, at: Column) -> Column:
        return sum((byte(digits, at + j) * (1 << 8 * j) for j in range(1, 4)), byte(digits, at))

    def hashed(digits: Column) -> Column:
        blocks = F.when(size >= 4, F.sequence(F.lit(0), F.floor(size / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        head = F.aggregate(blocks, F.lit(seed).cast("long"), lambda h, i: (rotl(h.bitwiseXOR(mixed(word(digits, i * 4))), 13) * 5 + ADD).bitwiseAND(F.lit(M32)))
        tail = F.when(size % 4 > 0, mixed(word(digits, F.floor(size / 4).cast("int") * 4))).otherwise(F.lit(0).cast("long"))
        h = fixed(fixed(head.bitwiseXOR(tail).bitwiseXOR(size.cast("long")), 16, MIX1), 13, MIX2)
        return _let(h, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 16)))

    return _let(text, hashed).bitwiseAND(F.lit(MASK31))


def fnv_combine(h: Column, g: Column) -> Column:
    """g ^ (h * prime mod 2^32); h below 2^32."""
    return (h * FNV_PRIME).bitwiseAND(F.lit(M32)).bitwiseXOR(g)


def fnv_combine_local(hashes: Sequence[int]) -> int:
    out = hashes[0]
    for g in hashes[1:]:
        out = g ^ (out * FNV_PRIME & M32)
    return out


def lr_mask(bits: int) -> int:
    return (1 << bits) - 1


def ffm_mask(bits: int, k: int) -> int:
    """Low bits, as many as k needs, are cleared, so that a feature's numbers begin apart."""
    return (1 << bits) - 1 ^ (1 << max(k - 1, 0).bit_length()) - 1
