"""From examples to model inputs: combined and masked feature hashes, in array or long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import CONSTANT_HASH, ffm_mask, fnv_combine, lr_mask
from ..plans.spec import ModelSpec
from .transforms import single, with_transforms

LR = "array<struct<hash:bigint,value:float,combo:int>>"
FFM = "array<struct<hash:bigint,value:float,field:int>>"


def _single(column: str) -> Column:
    """hash, value of a namespace; a float namespace's tokens have the weight one."""
    return F.transform(F.col(column), lambda x: F.struct(x["hash"].alias("hash"), x["weight"].alias("value")))


def _pairs(left: Column, right: Column) -> Column:
    """All pairs of two lists of features, hashes combined, values multiplied."""
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(fnv_combine(x["hash"], y["hash"]).alias("hash"), single(x["value"] * y["value"]).alias("value")))))


def _in_field(column: str, mask: int, number: int) -> Column:
    return F.transform(_single(column), lambda x: F.struct(x["hash"].bitwiseAND(F.lit(mask)).alias("hash"), x["value"].alias("value"), F.lit(number).alias("field"))).cast(FFM)


def combo(columns: tuple[str, ...], weight: float, mask: int, number: int) -> Column:
    """The features of one combination: all tuples of its namespaces' features, hashes folded from the left, masked at the end."""
    out = _single(columns[0])
    for c in columns[1:]:
        out = _pairs(out, _single(c))
    return F.transform(out, lambda x: F.struct(x["hash"].bitwiseAND(F.lit(mask)).alias("hash"), single(x["value"] * F.lit(weight).cast("float")).alias("value"), F.lit(number).alias("combo"))).cast(LR)


def lr_features(spec: ModelSpec) -> Column:
    mask = lr_mask(spec.bit_precision)
    parts = [combo(c.columns, c.weight, mask, i) for i, c in enumerate(spec.combos)]
    if spec.constant:
        parts.append(F.array(F.struct(F.lit(CONSTANT_HASH & mask).cast("long").alias("hash"), F.lit(1.0).cast("float").alias("value"), F.lit(len(spec.combos)).alias("combo"))).cast(LR))
    return F.concat(*parts).cast(LR) if parts else F.array().cast(LR)


def ffm_features(spec: ModelSpec) -> Column:
    """The union, duplicates kept, of each field's namespaces."""
    mask = ffm_mask(spec.ffm_bit_precision, spec.ffm_k)
    parts = [_in_field(c, mask, i) for i, columns in enumerate(spec.fields if spec.ffm_k else ()) for c in columns]
    return F.concat(*parts).cast(FFM) if parts else F.array().cast(FFM)


def featurize(examples: DataFrame, spec: ModelSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """example_num, label, importance, lr, ffm (and columns to keep) of each example."""
    rows = with_transforms(examples.select("example_num", "label", "importance", *keep, *spec.used_columns()), spec)
    return rows.select("example_num", "label", "importance", *keep, lr_features(spec).alias("lr"), ffm_features(spec).alias("ffm"))


def long_lr(features: DataFrame, *keys: str, empty: bool = False) -> DataFrame:
    """A row for each linear feature: example_num, combo, idx, v. empty: an example without features has one row of nulls.

    Exploded with empty lists and filtered afterwards: a plain explode has the
    optimizer filter by the list's size first, which computes all features twice.
    """
    names = keys or ("example_num",)
    rows = features.select(*names, F.explode_outer("lr").alias("x"))
    if not empty:
        rows = rows.where(F.col("x").isNotNull())
    return rows.select(*names, F.col("x.combo").alias("combo"), F.col("x.hash").alias("idx"), F.col("x.value").cast("double").alias("v"))


def long_ffm(features: DataFrame, *keys: str) -> DataFrame:
    """A row for each field's feature: example_num, i (place), f (field), h, v."""
    names = keys or ("example_num",)
    rows = features.select(*names, F.posexplode_outer("ffm").alias("i", "x")).where(F.col("x").isNotNull())
    return rows.select(*names, "i", F.col("x.field").alias("f"), F.col("x.hash").alias("h"), F.col("x.value").cast("double").alias("v"))
