"""Counts and hashes of words over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

#: Space and \t to \r.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: An odd multiplier: powers of it and of its inverse make prefix sums into hashes of substrings, modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def word_bounds(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a longest run of flagged bytes within a text), and each text's first word's number (one more than texts)."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    first = np.zeros(len(inside) + 1, bool)
    first[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


_kept: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n-1), remembered up to about a step's length."""
    if name not in _kept or len(_kept[name]) < n:
        found = _powers(base, max(n, 1 << 20))
        if len(found) > 8 << 20:
            return found[:n]
        _kept[name] = found
    return _kept[name][:n]


def hash_prefix(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE^place before each place."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers("up", BASE, len(data)), out=prefix[1:])
    return prefix


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes wherever they stand. prefix: hash_prefix(data), if it's there already."""
    if prefix is None:
        prefix = hash_prefix(data)
    with np.errstate(over="ignore"):
        value = (prefix[ends] - prefix[starts]) * powers("down", BASE_INVERSE, len(data) + 1)[starts]
        return mix(value ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words, by their first one's place; the last k-1 places have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out = mix(out * BASE + words[j : n + j])
        return out
