"""License phrases and notices in texts, by diagonal voting over word k-grams.

Rolling hashes of all k-grams of words of each text are joined in Spark with the
k-gram positions of the templates, a fixed small table. A hit votes for the
diagonal text place - template place; votes are summed by diagonal, neighbouring
diagonals of a long template merge (words may be left out or put in), both within SLACK and within
half the template's words, beyond which no span is similar enough; and spans
with enough votes are verified against the text's own words: phrases exactly,
longer notices by a matching-blocks similarity of at least 0.8.

Defined results: a null text is an empty one and has no places; rows that repeat
an id and a text have equal results (votes are counted by template place, not by
row); rows of one id but different texts are separate; a null id is an id like
any other; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, frame, id_text, steps, stored
from .text import LOWER, gram_hashes, word_bounds, word_hashes

#: Bytes of words, after lower-casing: digits, a-z and all of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

K = 2
#: Diagonals of a template of more than SHORT words merge if they are at most SLACK apart, or half its words.
SHORT, SLACK = 6, 3
#: Found spans travel to the texts if they are at most so many (some 24 bytes each); else texts meet them in a shuffle.
FEW_SPANS = 1_000_000
SIMILARITY = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Fixed values. The first three are the base phrases.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("bsd", "bsd license"),
    Template("mpl", "mozilla public license"),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("cc", "creative commons"),
    Template("cc", "licensed under cc by"),
    Template("cc", "licensed under cc0"),
    Template("isc", "isc license"),
    Template("unlicense", "released into the public domain"),
    Template("reserved", "all rights reserved"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
)


def _hash_words(words: Sequence[str]) -> np.ndarray:
    line = " ".join(words).encode()
    data = np.frombuffer(line, np.uint8)
    starts, ends, _ = word_bounds(WORD[data], np.array([0, len(line)]))
    return word_hashes(data, starts, ends)


def grams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, grams: hashes of each K consecutive words of a row's whole text, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                data, bounds = as_bytes(step.column(1))
                data = LOWER[data]
                starts, ends, at = word_bounds(WORD[data], bounds)
                hashed = gram_hashes(word_hashes(data, starts, ends), K)
                # Places whose gram would run into the next text are left out.
                n = np.maximum(np.diff(at) - K + 1, 0)
                keep = np.ones(len(hashed), bool)
                for j in range(1, K):
                    last = at[1:] - j
                    last = last[(last >= at[:-1]) & (last < len(keep))]
                    keep[last] = False
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(hashed[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([step.column(0), step.column(2), lists], ["doc_id", "text_key", "grams"])

    keyed = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, grams array<long>")


def spans(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, template, first, stop: candidate spans (words from first up to stop) with enough votes."""
    places = []
    for i, t in enumerate(templates):
        hashed = gram_hashes(_hash_words(t.words), K).view(np.int64).tolist()
        places += [(h, i, at) for at, h in enumerate(hashed)]
    # The templates are a parameter of a fixed size, so their places are a table of some hundred rows.
    table = F.broadcast(frame(docs.sparkSession, places, "gram long, template int, place int"))
    each = grams(docs, id_col, text_col).select("doc_id", "text_key", F.posexplode("grams").alias("at", "gram"))
    hits = each.join(table, "gram").select("doc_id", "text_key", "template", (F.col("at") - F.col("place")).alias("diagonal"), "place")
    # At most one hit a template place on a diagonal, but for rows that repeat: collecting places as bits would limit templates, so distinct first.
    votes = hits.distinct().groupBy("doc_id", "text_key", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"))
    sizes = [len(t.words) for t in templates]
    size = F.element_at(F.array(*map(F.lit, sizes)), F.col("template") + 1)
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(0))
    half = F.greatest(F.lit(SLACK), F.floor(size / 2))
    bundle = lambda gap: 1 + F.sum((F.col("far") > F.when(size > SHORT, gap).otherwise(0)).cast("int")).over(order)
    groups = votes.withColumn("far", far).withColumns({"near": bundle(F.lit(SLACK)), "wide": -bundle(half)})
    # Both ways of merging, told apart by their sign; for a phrase they are the same.
    groups = groups.withColumn("bundle", F.explode(F.when(size > SHORT, F.array("near", "wide")).otherwise(F.array("near"))))
    merged = groups.groupBy("doc_id", "text_key", "template", "bundle").agg(F.sum("votes").alias("votes"), F.min(F.col("diagonal") + F.col("low")).alias("first"), F.max(F.col("diagonal") + F.col("high") + K).alias("stop"))
    need = F.when(size > SHORT, F.ceil(0.5 * (size - K + 1))).otherwise(size - K + 1)
    return merged.where(F.col("votes") >= need).select("doc_id", "text_key", "template", "first", "stop").distinct()


def best_spans(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Without spans (label, first, stop, similarity) that lie on a better one of their label; in order."""
    kept: dict[str, list[tuple[str, int, int, float]]] = {}
    for x in sorted(found, key=lambda x: (-x[3], x[1], x[2])):
        own = kept.setdefault(x[0], [])
        at = bisect.bisect_left(own, x[1], key=lambda y: y[1])
        if (at == 0 or own[at - 1][2] <= x[1]) and (at == len(own) or own[at][1] >= x[2]):
            own.insert(at, x)
    return sorted(x for own in kept.values() for x in own)


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first, stop, similarity; words from first up to stop) of each row."""
    found = stored(spans(docs, templates, id_col, text_col).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("template", "first", "stop"))).alias("found")), "found")
    if (found.agg(F.sum(F.size("found"))).first()[0] or 0) <= FEW_SPANS:
        found = F.broadcast(found)
    rows = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    both = rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_key") == F.col("f.text_key")), "left").select("r.doc_id", "r.text", "f.found")
    fixed = [(t.label, t.base, [w.encode() for w in t.words]) for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                data, bounds = as_bytes(step.column(1))
                data = LOWER[data]
                starts, ends, at = word_bounds(WORD[data], bounds)
                out = []
                for k, (doc_id, spans_) in enumerate(zip(step.column(0).to_pylist(), step.column(2).to_pylist(), strict=True)):
                    good, base = [], []
                    for x in spans_ or ():
                        label, is_base, words = fixed[x["template"]]
                        own = slice(at[k] + x["first"], min(at[k] + x["stop"], at[k + 1]))
                        there = [data[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
                        if is_base or len(words) <= SHORT:
                            similarity = float(there == words)
                        else:
                            m = SequenceMatcher(None, there, words, autojunk=False)
                            similarity = m.ratio()
                        if similarity >= SIMILARITY:
                            good.append((label, x["first"], x["stop"], similarity))
                            if is_base:
                                base.append((x["first"], label))
                    good = best_spans(good)
                    out.append((doc_id, int(at[k + 1] - at[k]), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted({x[0] for x in good})), max((x[3] for x in good), default=0.0), [dict(zip(SPAN, x, strict=True)) for x in good]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)

    SPAN = ["label", "first", "stop", "similarity"]
    NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    KINDS = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("similarity", pa.float64())]))]
    return both.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,stop:long,similarity:double>>")
