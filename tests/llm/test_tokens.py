"""Byte-level BPE (8) and packing (6)."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparsemill.llm import byte_bpe, packing

from .helpers import frame, same_rows, texts

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@lru_cache
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_encodes_as_ever_and_comes_back(text):
    codec = byte_bpe.codec(RANKS, P.PATTERN)
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == known().encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_round_trip(spark):
    got = byte_bpe.round_trip(frame(spark), RANKS, P.PATTERN).collect()
    want = []
    for i, t in texts():
        ids = np.array(known().encode_ordinary(t), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    same_rows(got, want)


def test_encode_decode_tables(spark):
    encoded = byte_bpe.encode(frame(spark), RANKS, P.PATTERN)
    decoded = byte_bpe.decode(encoded, RANKS, P.PATTERN).collect()
    same_rows([(r.doc_id, bytes(r.decoded)) for r in decoded], [(i, t.encode()) for i, t in texts()])


def test_empty_table(spark):
    none = frame(spark, [])
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN).count() == 0
    assert packing.pack(none, JSON).count() == 0


def test_pack(spark):
    tokenizer = Tokenizer.from_file(JSON)
    rows = packing.pack(frame(spark), JSON).collect()
    docs = Counter()
    for i, t in texts():
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        docs.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter(tuple(r)[:5] for r in rows) == docs
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in rows) // 1024) + 2


def best(lengths, capacity):
    """The fewest bins, by trying all."""
    lengths = sorted(lengths, reverse=True)
    found = [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= found[0]:
            return
        if k == len(lengths):
            found[0] = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= lengths[k]}):
            rest = list(rooms)
            rest.remove(r)
            go(k + 1, [*rest, r - lengths[k]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return found[0]


def used(pattern_list):
    out = Counter()
    for pattern, times in pattern_list:
        for x in pattern:
            out[x] += times
    return +out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_loses_nothing(lengths):
    """The fixed sets and the best packing of the rest are a best packing of all."""
    fixed, rest = packing.reduce_by_dominance(Counter(lengths), 20)
    assert used(fixed) + Counter(rest) == Counter(lengths)
    left = list(Counter(rest).elements())
    assert sum(t for _, t in fixed) + (best(left, 20) if left else 0) == best(lengths, 20)


def test_plan_uses_each_piece_once_and_no_more_than_fits():
    rng = random.Random(5)
    counts = Counter(rng.choice([rng.randint(1, 1024), rng.randint(300, 420), 341]) for _ in range(20_000))
    plan = packing.plan(counts, 1024)
    assert used(plan) == counts and all(sum(p) <= 1024 for p, _ in plan)
    assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(counts, 1024)) and len(plan) < 8192


def test_fast_ids_are_the_exact_ones():
    e = packing.encoder(JSON)
    rng = random.Random(1)
    usual = [chr(c) for c in [9, 10, *range(0x20, 0xA000)] if not re.match(packing.UNUSUAL, chr(c))]
    assert len(usual) > 20_000
    for k in range(3000):
        some = [rng.choice(usual) for _ in range(6)] + list("ab  1's.\n") if k % 2 else list("ab  é\nÑ1'st9,.-ü\tßŁ")
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 60)))
        assert not e.unusual.search(text)
        assert e.fast.encode_ordinary(text) == e.exact.encode(text, add_special_tokens=False).ids, text
    every = "".join(f"a{c}1 {c}{c}" for c in usual)  # each of them between a letter, a digit and a blank
    assert e.fast.encode_ordinary(every) == e.exact.encode(every, add_special_tokens=False).ids
    long = "plain words and 12 numbers. " * 60_000
    assert e(long).tolist() == e.exact.encode(long, add_special_tokens=False).ids
    plain = Tokenizer.from_file(JSON)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "x<|endoftext|><|endoftext|>\n"):
        assert e(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert e("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    assert e("<|endoftext|>\u2028x").tolist() == e.exact.encode("<|endoftext|>\u2028x", add_special_tokens=False).ids
