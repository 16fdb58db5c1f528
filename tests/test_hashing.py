import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparsemill.functions import hashing as H


@pytest.mark.parametrize(("ns", "token", "want"), [("A", "a", 2988156968), ("B", "b", 2422381320), ("B", "3", 1775699190)])
def test_token_values(ns, token, want):
    assert H.murmur3(token.encode(), H.namespace_seed(ns)) & H.MASK31 == want & H.MASK31


def test_interaction_and_constant():
    a, b = H.token_hash_local("a", "A"), H.token_hash_local("b", "B")
    assert H.fnv_combine_local([a, b]) & H.lr_mask(18) == 208368
    assert H.CONSTANT_HASH & H.lr_mask(18) == 116060


def test_field_mask():
    assert [x & H.ffm_mask(18, 3) for x in (0xFFF, 0xFEB, 0x1)] == [0xFFC, 0xFE8, 0x0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=20), st.integers(0, H.M32))
def test_array_is_the_scalar_one(tokens, seed):
    got = H.murmur3_array(pa.array(tokens, pa.string()), seed)
    assert got.tolist() == [H.murmur3(t.encode(), seed) for t in tokens]


@given(st.integers(0, H.M32))
def test_seeding_integer(seed):
    assert H.murmur3((H.seeding_integer(seed) & H.M32).to_bytes(4, "little"), 42) == seed


def test_columns(spark):
    tokens = ["", "a", "abc", "abcd", "Herbivore-65", "hello world", "žluťoučký", "x" * 33]
    seed = H.namespace_seed("A")
    want = [H.murmur3(t.encode(), seed) & H.MASK31 for t in tokens]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    rows = df.select("i", H.token_hash_native(F.col("t"), seed).alias("n"), H.token_hash(F.array("t", "t"), seed).alias("u")).orderBy("i").collect()
    assert [r.n for r in rows] == want and [r.u for r in rows] == [[w, w] for w in want]
    numbers = [0, 1, -1, 7, 2**31 - 1, -(2**31)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x int")
    for s in (0, 42, 0xFFFFFFFF, 123456789):
        rows = df.select("i", H.int_hash(s, F.col("x")).alias("one"), H.int_hash(s, F.col("x"), F.col("x")).alias("two")).orderBy("i").collect()
        raw = lambda x: (x & H.M32).to_bytes(4, "little")
        assert [r.one for r in rows] == [H.murmur3(raw(x), s) & H.MASK31 for x in numbers]
        assert [r.two for r in rows] == [H.murmur3(raw(x), H.murmur3(raw(x), s)) & H.MASK31 for x in numbers]


def test_null_tokens(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "i int, t array<string>")
    got = [r.h for r in df.select("i", H.token_hash(F.col("t"), 0).alias("h")).orderBy("i").collect()]
    assert got[0] == [H.murmur3(b"a") & H.MASK31] and got[1] == [] and got[2] is None
    assert np.all(H.murmur3_array(pa.array([], pa.string()), 1) == np.zeros(0))
