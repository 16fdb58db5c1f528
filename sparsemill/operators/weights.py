"""Weight tables: statistics, quantisation, differences, inference form."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Buckets, decimals of the bounds, every how manieth weight the mean takes, the mean that means trouble.
BUCKETS, DECIMALS, MEAN_EVERY, SKEWED = 65025, 4, 10, 10.0


def statistics(weights: DataFrame) -> DataFrame:
    """min_w, max_w (rounded half away from zero), mean_w (of each tenth place), skewed. weights: idx, w."""
    w = F.col("w").cast("double")
    out = weights.agg(F.round(F.min(w), DECIMALS).alias("min_w"), F.round(F.max(w), DECIMALS).alias("max_w"), F.avg(F.when(F.col("idx") % MEAN_EVERY == 0, w)).alias("mean_w"))
    return out.withColumn("skewed", F.abs("mean_w") > SKEWED)


@F.pandas_udf(T.FloatType())
def half(x: pd.Series) -> pd.Series:
    """Rounded to half precision."""
    with np.errstate(over="ignore"):
        return pd.Series(x.to_numpy(np.float32).astype(np.float16).astype(np.float32))


def quantize(weights: DataFrame) -> DataFrame:
    """idx, q (a bucket's number in half precision), low, increment. Equal weights all fall to bucket 0."""
    found = statistics(weights).first()
    low, high = (np.float32(x or 0.0) for x in (found.min_w, found.max_w))
    increment = np.float32((high - low) / np.float32(BUCKETS))
    rows = weights.withColumns({"low": F.lit(float(low)).cast("float"), "increment": F.lit(float(increment)).cast("float")})
    bucket = F.when(F.col("increment") == 0, F.lit(0.0)).otherwise(F.try_divide((F.col("w").cast("float") - F.col("low")).cast("double"), F.col("increment").cast("double")))
    return rows.select("idx", half(F.round(bucket).cast("float")).alias("q"), "low", "increment")


def dequantized(q: Column, low: Column, increment: Column) -> Column:
    return (low + (q * increment).cast("float")).cast("float")


def dequantize(quantized: DataFrame) -> DataFrame:
    return quantized.select("idx", dequantized(F.col("q"), F.col("low"), F.col("increment")).alias("w"))


def quantized_bytes(weights: np.ndarray) -> bytes:
    """The compact form: increment and minimum in single precision, then half-precision buckets, little-endian."""
    w = np.asarray(weights, np.float32)
    up = lambda x: np.float32(np.copysign(np.floor(np.abs(x) * np.float32(10.0**DECIMALS) + np.float32(0.5)), x) / np.float32(10.0**DECIMALS))
    low, high = up(w.min()), up(w.max())
    increment = np.float32((high - low) / np.float32(BUCKETS))
    bucket = np.zeros_like(w) if increment == 0 else np.round((w - low) / increment)
    return increment.tobytes() + low.tobytes() + bucket.astype("<f2").tobytes()


def dequantized_bytes(data: bytes) -> np.ndarray:
    increment, low = np.frombuffer(data, "<f4", 2)
    return (low + np.frombuffer(data, "<f2", offset=8).astype(np.float32) * increment).astype(np.float32)


def to_inference(weights: DataFrame) -> DataFrame:
    """Weights without the optimizer's state."""
    return weights.select("block", "idx", "w")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """pos, delta (from the previous difference), new: places that differ. Both: pos, b; of equal length."""
    rows = old.select("pos", F.col("b").alias("a")).join(new.select("pos", "b"), "pos", "full")
    # Differences only, numbered by place: what a changed model sends.
    wrong = F.raise_error(F.lit("files differ in length"))
    changed = rows.where(F.when(F.col("a").isNull() | F.col("b").isNull(), wrong.cast("boolean")).otherwise(F.col("a") != F.col("b")))
    # Places are cut into ranges, so that no window holds all of them.
    span = changed.select("pos", "b", F.shiftright("pos", 20).alias("part"))
    last = span.groupBy("part").agg(F.max("pos").alias("last"))
    order = Window.orderBy("part")  # a row for each million places
    before = last.select("part", F.lag("last").over(order).alias("before"))
    local = span.withColumn("prev", F.lag("pos").over(Window.partitionBy("part").orderBy("pos")))
    return local.join(before, "part").select("pos", (F.col("pos") - F.coalesce("prev", "before", F.lit(0))).alias("delta"), F.col("b").alias("new"))


def apply_diff(old: DataFrame, changes: DataFrame) -> DataFrame:
    """pos, b after the changes."""
    return old.join(changes.select("pos", "new"), "pos", "left").select("pos", F.coalesce("new", "b").alias("b"))


def varint(n: int) -> bytes:
    """Seven bits a byte, lowest first, the top bit set on all but the last."""
    if n < 0:
        raise ValueError("varints are of non-negative numbers")
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """A number and where the next one begins."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a varint ends too early")
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if not data[at - 1] & 128:
            return value, at


def diff_bytes(old: bytes, new: bytes) -> bytes:
    """A compressed stream of (distance from the last difference, new byte)."""
    if len(old) != len(new):
        raise ValueError("files differ in length")
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    at = np.flatnonzero(a != b)
    out = b"".join(varint(int(d)) + bytes([int(b[p])]) for d, p in zip(np.diff(at, prepend=0), at, strict=True))
    return zlib.compress(out)


def apply_diff_bytes(old: bytes, changes: bytes) -> bytes:
    out, data, at, pos = bytearray(old), zlib.decompress(changes), 0, 0
    while at < len(data):
        d, at = read_varint(data, at)
        pos += d
        out[pos] = data[at]
        at += 1
    return bytes(out)
