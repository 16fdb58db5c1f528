"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

A rank file has one token a line: base64 of its bytes, and its rank. Each byte is
mapped to a printable character, each token becomes the piece of its mapped bytes
with the score -rank, and normalisation does nothing. A text is cut into
pre-tokens by a pattern; sentencepiece merges each one's characters, best score
first and leftmost on ties, which is the merge order of byte-level BPE. Decoding
maps pieces back to bytes.

Defined results: a null text is an empty one; an empty text has no tokens; equal
rows give equal rows; an empty table gives an empty table; a null doc_id stays
null; columns besides the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import id_text, steps

#: Pre-tokens that a worker remembers, and the longest one it remembers (in characters).
REMEMBERED, LONGEST = 200_000, 40


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 has a visible one, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """A field in protobuf's wire format."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as file:
        found = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in file if line.strip()))
    if [r for r, _ in found] != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in found]


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the unknown piece comes last."""
    to = byte_characters()
    pieces = [_field(1, _field(1, "".join(map(to.__getitem__, t)).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec(dict):
    """Encodes and decodes texts; as a dict, the ids of pre-tokens met so far, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        tokens = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.mapped = dict(enumerate(byte_characters()))
        back = {c: b for b, c in self.mapped.items()}
        self.pieces = [bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(len(tokens))]

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.model.encode(word.encode().decode("latin-1").translate(self.mapped)), "<u4").tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit ids) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in steps(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.encode(t) for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of rows of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(t or b"") for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text and decodes its ids, keeping digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in steps(batch):
                n, a, b = [], [], []
                for text in part.column(1).to_pylist():
                    ids = c.encode(text)
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
