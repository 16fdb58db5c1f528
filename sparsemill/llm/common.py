"""Small tools that the corpus operators share.

Every operator reads only the columns it names (an id and a text, say), so that
extra columns of any name, even clashing ones, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import shared_dir, stored

__all__ = ["as_bytes", "bounded_sample", "crc_mod", "frame", "fresh", "id_text", "offsets", "shared_dir", "steps", "stored"]

#: Bytes of text that one step of a batch function holds at a time; a single longer text is a step of its own.
STEP_BYTES = 1 << 20


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of docs has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators on documents read; a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about STEP_BYTES of text, one row at least."""
    if not batch.num_rows:
        return
    ends = offsets(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + STEP_BYTES, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def offsets(texts: pa.Array) -> np.ndarray:
    """Ends of the texts in the array's data buffer, the first one's start before them."""
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, without copying, and the bounds of each (one more than texts)."""
    ends = offsets(texts)
    data = texts.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[ends[0] : ends[-1]], ends - ends[0]


def crc_mod(column: str, n: int):
    """crc32 of a column's text, mod n; null where the column is null."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def bounded_sample(rows: DataFrame, rows_each: int, chars_each: int, by: str | None = None) -> DataFrame:
    """Of rows (doc_id, text, and `by`, of few values), for each value of `by` at most rows_each distinct (doc_id, text) of chars_each characters altogether.

    They are taken in the order of their ids' hashes; a row that no longer fits is
    passed over. The driver sees rows_each ids of each value, and no texts.
    """
    keyed = stored(rows.withColumns({"text_key": F.xxhash64("text"), "chars": F.char_length("text").cast("long")}), "sample")
    sizes = keyed.select("doc_id", "text_key", "chars", (F.col(by) if by else F.lit(0)).alias("by")).distinct()
    chosen = []
    for value in [r[0] for r in sizes.select("by").distinct().orderBy("by").collect()] if by else [0]:
        left = chars_each
        for r in sizes.where(F.col("by") == value).orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(rows_each).collect():
            if r.chars <= left:
                left -= r.chars
                chosen.append((r.doc_id, r.text_key))
    few = F.broadcast(frame(rows.sparkSession, chosen, "doc_id long, text_key long"))
    return keyed.join(few, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]).select(*rows.columns)


def frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A small table of the driver's rows."""
    return spark.createDataFrame(rows, schema)
