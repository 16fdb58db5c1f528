"""Transformed namespaces as native columns: binners, ratios, combinations, weights.

All arithmetic is in single precision where the results feed a hash. Integers that
come from floats saturate; infinities and NaN hash by their bits.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import int_hash, transform_seeds
from ..plans.dsl import BINNERS, RATIOS, Transform
from ..plans.spec import ModelSpec

#: What a transformed namespace's column holds.
EMITTED = "array<struct<hash:bigint,weight:float,fval:float>>"
INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def _bits(x: float) -> int:
    return struct.unpack("<i", struct.pack("<f", x))[0]


def single(x: Column) -> Column:
    return x.cast("float")


def to_int(x: Column) -> Column:
    """Truncated and saturated; 0 for NaN."""
    clamped = F.greatest(F.lit(float(INT_MIN)), F.least(F.lit(float(INT_MAX)), x.cast("double")))
    return F.when(F.isnan(x), F.lit(0)).otherwise(clamped.cast("int")).cast("int")


def _feature(hashed: Column, value: Column) -> Column:
    return F.struct(hashed.alias("hash"), single(value).alias("weight"), F.lit(None).cast("float").alias("fval"))


def emit_int(seed: int, x: Column, value: Column) -> Column:
    return F.array(_feature(int_hash(seed, x), value))


def emit_float(seed: int, f: Column, value: Column, interpolated: bool) -> Column:
    """One emission; interpolated: up to two, floor + 1 first, weighted by nearness."""
    odd = F.when(F.isnan(f), _bits(math.nan)).when(f > 0, _bits(math.inf)).otherwise(_bits(-math.inf)).cast("int")
    finite = ~F.isnan(f) & (F.abs(f) < F.lit(math.inf))
    if not interpolated:
        return emit_int(seed, F.when(finite, to_int(f)).otherwise(odd), value)
    floor = to_int(F.floor(F.when(finite, f).otherwise(F.lit(0.0)).cast("double")).cast("double"))
    part = single(single(f) - single(F.floor(F.when(finite, f).otherwise(F.lit(0.0)))))
    upper = F.when(floor == INT_MAX, F.lit(INT_MIN)).otherwise(F.when(floor < INT_MAX, floor).otherwise(0) + 1).cast("int")
    pair = F.array(_feature(int_hash(seed, upper), value * part), _feature(int_hash(seed, floor), value * single(F.lit(1.0).cast("float") - part)))
    kept = F.filter(pair, lambda x: x["weight"] != 0)
    # A part of zero leaves its emission out, whatever the value is.
    whole = F.when(part == 0, F.slice(pair, 2, 1)).otherwise(pair)
    return F.when(finite, F.when(value == 0, whole).otherwise(kept)).otherwise(emit_int(seed, odd, value))


def _param(t: Transform, at: int, default: float) -> Column:
    return F.lit(t.params[at] if len(t.params) > at else default).cast("float")


def _curve(kind: str, x: Column) -> Column:
    if kind == "sqrt":
        return single(F.sqrt(x.cast("double")))
    return single(F.when(x.cast("double") > 0, F.log(x.cast("double"))).when(x == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan)))


def transformed(t: Transform, columns: list[str]) -> Column:
    """The column of a transformed namespace, from its sources' columns."""
    seeds = transform_seeds(t.index)
    sources = [F.col(c) for c in columns]
    above, resolution = _param(t, 0, 0.0), _param(t, 1, 1.0)
    one = F.lit(1.0).cast("float")
    if t.function in BINNERS:
        kind, interpolated = BINNERS[t.function]

        def binned(x: Column) -> Column:
            v = x["fval"]
            return F.when(v < above, emit_int(seeds[0], to_int(v), one)).otherwise(emit_float(seeds[1], single(_curve(kind, single(v - above)) * resolution), one, interpolated))

        return F.flatten(F.transform(sources[0], binned)).cast(EMITTED)
    if t.function in RATIOS:

        def ratio(x: Column, y: Column) -> Column:
            a, b = x["fval"], y["fval"]
            interpolated = RATIOS[t.function]
            return (
                F.when(single(a + b) < above, F.array(_feature(int_hash(seeds[1], to_int(a), to_int(b)), one)))
                .when(a == 0, emit_float(seeds[2], _curve("log", single(b - above)), one, interpolated))
                .when(b == 0, emit_float(seeds[3], _curve("log", single(a - above)), one, interpolated))
                .otherwise(emit_float(seeds[0], single(_curve("log", single(F.try_divide(a.cast("double"), b.cast("double")))) * resolution), one, interpolated))
            )

        return F.flatten(F.flatten(F.transform(sources[0], lambda x: F.transform(sources[1], lambda y: ratio(x, y))))).cast(EMITTED)
    if t.function == "Weight":
        return F.transform(sources[0], lambda x: _feature(int_hash(seeds[0], _signed(x["hash"])), x["weight"] * _param(t, 0, 1.0))).cast(EMITTED)
    combined = F.transform(sources[0], lambda x: F.struct(x["hash"].alias("hash"), x["weight"].alias("weight")))
    for source in sources[1:]:
        combined = _product(combined, source)
    return F.transform(combined, lambda x: _feature(int_hash(seeds[0], _signed(x["hash"])), x["weight"])).cast(EMITTED)


def _signed(h: Column) -> Column:
    """The 32 bits of an unsigned number as a signed integer."""
    return F.when(h > INT_MAX, h - (1 << 32)).otherwise(h).cast("int")


def _product(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(x["hash"].bitwiseXOR(y["hash"]).alias("hash"), single(x["weight"] * y["weight"]).alias("weight")))))


def with_transforms(examples: DataFrame, spec: ModelSpec) -> DataFrame:
    """examples with a column for each transform that the model uses, once each, in the order of their resolution."""
    used = {c for combo in spec.combos for c in combo.columns} | {c for f in spec.fields for c in f}
    for t in reversed(spec.transforms):
        if t.column in used:
            used |= {spec.column_of(s) for s in t.sources}
    for t in spec.transforms:
        if t.column in used:
            examples = examples.withColumn(t.column, transformed(t, [spec.column_of(s) for s in t.sources]))
    return examples
