"""Packs tokenised documents into as few fixed-size sequences as it can: dominance reduction, then best fit.

Lengths are at most the capacity, so a table of how many pieces have each length
describes the whole instance in a bounded space, whatever the corpus. The driver
works on that table only and packs equal pieces together, so a plan is a short
list of patterns (lengths that share a sequence) and how often each is used.

Reduction (Martello and Toth): a set of pieces that holds piece j dominates
another one if the other's pieces can be swapped into its places; if one set
dominates all that can hold j, some optimal packing uses it, so it is fixed and
the instance shrinks. Applied with the sets {j}, {j, s} and {j, s, b}. The rest
is packed largest first, each piece where it leaves the least room.

Pieces are numbered within their length by counts of input partitions, so no
group of equal lengths is gathered in a task.

Tokens: ids of a `tokenizers` file, and an end id. Texts of common characters,
which are split alike everywhere, are encoded by tiktoken with the same
vocabulary, about six times as fast; all others, and those that hold the string of
a special or other added token, by tokenizers itself.

Defined results: a null or empty text is the end id alone, one piece; equal rows
are packed each; a null doc_id stays null; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import byte_characters
from .common import id_text, steps, stored

#: Anything but characters whose classes (letter, digit, blank, other) all versions of Unicode agree on: printable
#: ASCII, tab and line feed; Latin, Greek, Cyrillic, kana and the first Han letters; Latin-1's and general punctuation.
UNUSUAL = "[^\t\n\x20-\x7e\xa1-\xac\xae-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e\u20a0-\u20b1\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids as tokenizers gives them without adding special tokens: those that stand in a text are known."""

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        back = {c: b for b, c in enumerate(byte_characters())}
        pieces = self.exact.get_vocab(with_added_tokens=False)
        added = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        ranks = {bytes(map(back.__getitem__, p)): i for p, i in pieces.items() if p not in added}
        self.unusual = re.compile("|".join([UNUSUAL, *map(re.escape, sorted(added))]))
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not self.unusual.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, place: each piece, and its number among pieces of its length in its input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for step in steps(batch):
                rows = []
                for doc_id, text in zip(step.column(0).to_pylist(), step.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text), end_id).astype("<u4")
                    at, to = 0, (len(ids) - 1) % capacity + 1  # the first piece takes what the others leave
                    k = 0
                    while at < len(ids):
                        rows.append((doc_id, k, at, to - at, zlib.crc32(ids[at:to].tobytes()), part, seen[to - at]))
                        seen[to - at] += 1
                        at, to, k = to, to + capacity, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
    KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns that some optimal packing uses, with how often, and the counts that remain.

    A set fixed once is fixed as often as its pieces last: fewer other pieces
    only take away sets that it has to dominate.
    """
    n = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        n[length] = count
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(pattern: tuple[int, ...]) -> None:
        need = {x: pattern.count(x) for x in pattern}
        times = min(int(n[x]) // k for x, k in need.items())
        for x, k in need.items():
            n[x] -= times * k
        fixed.append((pattern, times))

    for j in range(capacity, 0, -1):
        while n[j]:
            room = capacity - j
            free = n[: room + 1].copy()
            if j <= room:
                free[j] -= 1
            lengths = np.flatnonzero(free)
            if not len(lengths):
                if j <= room and n[j] > 1:
                    raise AssertionError("unreachable: a second piece of this length would fit")
                fix((j,))
                continue
            s = int(lengths[-1])
            smallest = np.repeat(lengths[:3], np.minimum(free[lengths[:3]], 3))[:3]
            if s == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
                fix((j, s))  # s fills the room, or nothing fits beside a piece in the room
                continue
            if len(smallest) == 3 and smallest.sum() <= room:
                break  # three more may fit: no rule
            # Two more at most. For each y, x is the largest that fits beside it, x >= y.
            free_s = free.copy()
            free_s[s] -= 1
            beside = np.flatnonzero(free_s[: room - s + 1]) if s < room else lengths[:0]
            b = int(beside[-1]) if len(beside) else 0
            best = worst = 0
            for y in lengths[lengths <= room // 2].tolist():
                xs = lengths[(lengths >= y) & (lengths <= room - y)]
                if len(xs) and xs[-1] == y and free[y] < 2:
                    xs = xs[:-1]
                if len(xs):
                    best = max(best, y + int(xs[-1]))
                    if y > b:
                        worst = max(worst, y + int(xs[-1]))
            if best <= s:
                fix((j, s))  # any two that fit can both take the place of s
            elif b and worst <= s:
                fix((j, s, b) if s >= b else (j, b, s))  # pairs fit into s and b, or both into s
            else:
                break
    return fixed, {int(x): int(n[x]) for x in np.flatnonzero(n)}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over equal pieces at once: patterns, and how often each is used."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], room: int, times: int) -> None:
        if times:
            open_.setdefault(room, []).append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, bins in open_.items() if r >= length and bins), default=None)
            if room is None:
                each = min(capacity // length, left)
                put((length,) * each, capacity - each * length, left // each)
                left %= each
                continue
            pattern, times = open_[room].pop()
            each = min(room // length, left)
            used = min(times, left // each)
            put(pattern, room, times - used)
            put(pattern + (length,) * each, room - each * length, used)
            left -= used * each
    return [p for bins in open_.values() for p in bins]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, over all pieces."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    cut = stored(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    numbers = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbers = stored(numbers.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "numbers")
    counts = {r.length: r.n for r in numbers.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = dict.fromkeys(counts, 0)
    sequence = 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    table = {length: np.array(x, np.int64).T for length, x in slots.items()}
    # Patterns number a few times the capacity, whatever the corpus: each step uses up a length or a kind of open sequence.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            sequence_id, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                first, base, at = table[x]
                slot = np.searchsorted(first, number[own], "right") - 1
                sequence_id[own] = base[slot] + number[own] - first[slot]
                offset[own] = at[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence_id), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = cut.join(numbers.select("length", "part", "first"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("number"))
    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
