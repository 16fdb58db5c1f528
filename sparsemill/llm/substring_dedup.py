"""Passages that repeat, by content-defined chunks.

A gear hash rolls over the bytes of each text: h = 2 h + G[byte], 32 bits, so that
it depends on the last 32 bytes only. A text is cut after a blank where the top
bits of h are zero, after each line feed, and at LONGEST bytes; not before
SHORTEST bytes. As cuts follow the content, an insertion moves them only near
itself. Chunks are counted by digest; of equal chunks the first by (doc_id,
text key, place) stays. Runs of neighbouring repeated chunks with min_words words or more are
passages; the chunks of a passage that aren't the first of their kind are cut out.
A word of LONG_WORD bytes or more counts as one word for every WORD_BYTES of it.
Texts are read and chunked once.

A digest may have any number of places: counting is pre-aggregated, and places
meet the repeated digests in joins of two plain shuffles, which adaptive execution
splits where one digest is hot.

Defined results: a null text is an empty one and has no chunks; rows that repeat
an id and a text are one document (their chunks have the same places, so that all
stay or all go alike); rows that share an id but not a text are told apart by the
hash of the text and have runs of their own; rows of null id count as one smallest
id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, id_text, steps, stored
from .text import BLANK, word_bounds

SHORTEST, LONGEST = 16, 1000
#: A blank is a cut if this many top bits of the hash are zero.
CUT_BITS = 2
#: Without a blank for so many bytes, any character may be a cut, by so many bits.
UNSPACED, BARE_BITS = 48, 4
#: Words as long as this count by their bytes.
LONG_WORD, WORD_BYTES = 48, 6
#: 256 random words, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
NO_ID = -(1 << 63)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sums over the last 32 bytes by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            more = h.copy()
            more[k:] += h[:-k] << np.uint32(k)
            h = more
    return h


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text; the last one is its length."""
    n = len(text)
    if n == 0:
        return []
    data = np.frombuffer(text, np.uint8)
    blank, h, place = BLANK[data], gear_hashes(data), np.arange(n)
    at = blank & ((h >> np.uint32(32 - CUT_BITS)) == 0)
    at[:-1] &= ~blank[1:]  # the last of a run of blanks
    at |= data == 0x0A
    bare = place - np.maximum.accumulate(np.where(blank, place, -1)) >= UNSPACED
    if bare.any():
        bare[:-1] &= data[1:] & 0xC0 != 0x80  # not within a character
        at |= bare & ((h >> np.uint32(32 - BARE_BITS)) == 0)
    out, last = [], 0
    for end in (np.flatnonzero(at) + 1).tolist() + [n]:
        while end - last > LONGEST:
            to = last + LONGEST
            while text[to] & 0xC0 == 0x80 and to > last + LONGEST - 4:  # not within a character
                to -= 1
            out.append(to)
            last = to
        if end - last >= SHORTEST or end == n and end > last:
            out.append(end)
            last = end
    return out


def words_between(text: bytes, ends: list[int]) -> list[int]:
    """Words of each chunk, given their ends: those that begin there, and a share of long ones."""
    data = np.frombuffer(text, np.uint8)
    starts, stops, _ = word_bounds(~BLANK[data], np.array([0, len(data)]))
    sixths = np.zeros(len(data) + 1, np.int64)  # of a word: WORD_BYTES parts
    long = stops - starts >= LONG_WORD
    sixths[starts[~long]] = WORD_BYTES
    for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
        sixths[a:b] = 1
    total = np.concatenate([[0], np.cumsum(sixths)])[[0, *ends]]
    return (-(-np.diff(total) // WORD_BYTES)).tolist()


def digests(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, digest's upper and lower 64 bits, signed) of each chunk. Blanks at a chunk's end don't count: a passage may end a line here and a sentence there."""
    found, start = [], 0
    for end in cuts(text):
        d = xxhash.xxh3_128_digest(text[start:end].rstrip())
        found.append((start, end, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
        start = end
    return found


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, r (hash of the text), place, upper, lower: each chunk with a word. place packs (as the last 20 bits) its bytes and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                ids, keys, place, upper, lower = [], [], [], [], []
                for doc_id, r, text in zip(step.column(0).to_pylist(), step.column(2).to_pylist(), step.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    found = digests(text)
                    for (start, end, a, b), words in zip(found, words_between(text, [x[1] for x in found]), strict=True):
                        if words:
                            ids.append(doc_id)
                            keys.append(r)
                            place.append(start << 20 | (end - start) << 10 | words)
                            upper.append(a)
                            lower.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, keys, place, upper, lower)], ["doc_id", "r", "place", "upper", "lower"])

    rows = id_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("r"))
    return rows.mapInArrow(run, "doc_id long, r long, place long, upper long, lower long")


def repeated_chunks(docs: DataFrame, min_words: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, r, start, stop, words, upper, lower, first_id, removed, run_start: chunks of passages that are found more than once (places in bytes)."""
    every = stored(chunks(docs, id_col, text_col), "chunks")
    # Half the digest finds what may repeat; the places of those few carry all of it.
    often = stored(every.groupBy("upper").count().where("count > 1").select("upper"), "often")
    places = stored(every.join(often, "upper"), "places")
    first = places.groupBy("upper", "lower").agg(F.min(F.struct("doc_id", "r", "place")).alias("first"), F.max(F.struct("doc_id", "r", "place")).alias("last"))
    first = stored(first.where("first <> last").select("upper", "lower", F.col("first.doc_id").alias("first_id"), F.col("first.r").alias("first_r"), F.col("first.place").alias("first_place")), "first")
    start = F.shiftright("place", 20)
    found = places.join(first, ["upper", "lower"]).select("doc_id", "r", start.alias("start"), (start + F.shiftright("place", 10).bitwiseAND(1023)).alias("stop"), F.col("place").bitwiseAND(1023).alias("words"), "upper", "lower", "first_id", ((F.col("doc_id") != F.col("first_id")) | (F.col("r") != F.col("first_r")) | (F.col("place") != F.col("first_place"))).alias("removed"))
    order = Window.partitionBy("doc_id", "r").orderBy("start", "stop", "upper", "lower")
    new = F.coalesce((F.lag("stop").over(order) != F.col("start")) | (F.lag("removed").over(order) != F.col("removed")), F.lit(True))
    # Rows that repeat an id and a text give a place twice. Dealt by document first: else the rows of a digest would have to stay together, and a hot one couldn't be split.
    numbered = found.repartition("doc_id", "r").distinct().withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    whole = Window.partitionBy("doc_id", "r", "run")
    long_enough = numbered.withColumn("run_words", F.sum("words").over(whole)).withColumn("run_start", F.min("start").over(whole))
    return long_enough.where(F.col("run_words") >= min_words).drop("new", "run", "run_words")


def repeated_passages(docs: DataFrame, min_words: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop, n_words, source_id, removed: each passage that is found more than once, with the smallest id that holds the first of one of its chunks; removed is false where it stays."""
    runs = repeated_chunks(docs, min_words, id_col, text_col).groupBy("doc_id", "r", "run_start", "removed")
    out = runs.agg(F.max("stop").alias("stop"), F.sum("words").alias("n_words"), F.min("first_id").alias("source_id"))
    clean = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(clean("doc_id"), F.col("run_start").alias("start"), "stop", "n_words", clean("source_id"), "removed")


def deduplicate(docs: DataFrame, min_words: int = 16, id_col: str = "doc_id", text_col: str = "text", out_col: str = "deduplicated", chunks_found: DataFrame | None = None) -> DataFrame:
    """docs with out_col: the text without passages that stand earlier, and out_col + '_chunks': how many chunks went. A null text stays null."""
    gone = (chunks_found if chunks_found is not None else repeated_chunks(docs, min_words, id_col, text_col)).where("removed")
    gone_id, gone_r, dropped, cut = fresh(docs, "gone_id", "gone_r", "gone", "cut")
    gone = gone.groupBy(F.col("doc_id").alias(gone_id), F.col("r").alias(gone_r)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(dropped))

    @F.arrow_udf("string")
    def without(texts: pa.Array, lists: pa.Array) -> pa.Array:
        flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))])
        start, stop = (flat.field(f).to_pylist() for f in ("start", "stop"))
        out = []
        for k in range(len(texts)):
            text, own = texts[k].as_py(), slice(ends[k], ends[k + 1])
            if text is not None:
                data = text.encode()
                text = b"".join(data[a:b] for a, b in zip([0, *stop[own]], [*start[own], len(data)], strict=True)).decode()
            out.append(text)
        return pa.array(out, pa.string())

    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col(gone_id)
    joined = docs.join(gone, own & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(gone_r)), "left")
    # Only texts that lose something go through Python.
    done = joined.withColumn(cut, without(F.when(F.col(dropped).isNotNull(), F.col(text_col).cast("string")), F.col(dropped)))
    kept = F.when(F.col(dropped).isNull(), F.col(text_col)).otherwise(F.col(cut))
    return done.select(*docs.columns, kept.alias(out_col), F.greatest(F.size(dropped), F.lit(0)).alias(f"{out_col}_chunks"))
