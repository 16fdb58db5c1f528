"""Model directories: the specification as JSON, weights as Parquet by block, and their checks."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.learn import local_weights
from ..operators.learner import Learner
from ..operators.weights import dequantize, quantize, to_inference
from ..plans.spec import ModelSpec
from .local import Predictor

FORMAT, VERSION = "sparse-feature model", 1
#: Options that may change when a model is loaded to learn on, and where they go. Each stands for itself: none sets another.
OVERRIDES = {"learning_rate": ("lr", "learning_rate"), "power_t": ("lr", "power_t"), "ffm_learning_rate": ("ffm", "learning_rate"), "ffm_power_t": ("ffm", "power_t")}


def save(spec: ModelSpec, weights: DataFrame, path: str, quantized: bool = False) -> None:
    """weights: block, idx, w, and acc unless the model is for predictions only. quantized: field weights in half-precision buckets; the format is recorded."""
    spark = weights.sparkSession
    with_state = "acc" in weights.columns and not quantized
    rows = weights if with_state else to_inference(weights)
    if quantized:
        fields = quantize(rows.where("block = 'ffm'").select("idx", "w"))
        fields.write.mode("overwrite").parquet(f"{path}/quantized")
        rows = rows.where("block <> 'ffm'")
    rows.write.mode("overwrite").partitionBy("block").parquet(f"{path}/weights")
    sizes = {r.block: r.n for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    meta = {"format": FORMAT, "version": VERSION, "quantized": quantized, "state": with_state, "sizes": sizes, "spec": json.loads(spec.to_json())}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def describe(spark: SparkSession, path: str) -> dict:
    meta = json.loads(spark.read.text(f"{path}/model", wholetext=True).first().value)
    if meta.get("format") != FORMAT:
        raise ValueError("Cache header does not begin with the expected magic bytes: this is no model")
    if meta.get("version") != VERSION:
        raise ValueError(f"Cache file version of this model {VERSION} differs from {meta.get('version')}")
    return meta


def load(spark: SparkSession, path: str, immutable: bool = False, like: ModelSpec | None = None, **overrides: float | None) -> tuple[ModelSpec, DataFrame]:
    """Specification and weights. immutable: the optimizer's state isn't read. like: the model that it has to agree with. overrides: new values of OVERRIDES. Row counts of blocks are checked."""
    meta = describe(spark, path)
    spec = ModelSpec.from_json(json.dumps(meta["spec"]))
    if like is not None and like.to_json() != spec.to_json():
        raise ValueError("the model differs from the one in use")
    for name, value in overrides.items():
        block, rate = OVERRIDES[name]
        if value is not None:
            setattr(spec, block, replace(getattr(spec, block), **{rate: value}))
    kept = ["block", "idx", "w"] + (["acc"] if meta["state"] and not immutable else [])
    rows = spark.read.schema("idx long, w float, acc float, block string" if meta["state"] else "idx long, w float, block string").parquet(f"{path}/weights").select(*kept)
    found = {r.block: r.n for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    for block in {*found, *meta["sizes"]}:
        if found.get(block, 0) != meta["sizes"].get(block, 0):
            raise ValueError(f"{block}: the model was saved with {meta['sizes'].get(block, 0)} weights, and {found.get(block, 0)} are there")
    if meta["quantized"]:
        fields = dequantize(spark.read.parquet(f"{path}/quantized"))
        rows = rows.select("block", "idx", "w").union(fields.select(F.lit("ffm"), "idx", "w"))
    if immutable:
        spec.optimizer = "sgd"
    return spec, rows


def convert_to_inference(spark: SparkSession, path: str, to: str, quantized: bool = False) -> None:
    """A copy without the optimizer's state."""
    spec, rows = load(spark, path, immutable=True)
    save(spec, rows, to, quantized)


def predictor(spark: SparkSession, path: str) -> Predictor:
    """A model for single lines, in memory: as large as its options make it."""
    spec, weights = load(spark, path, immutable=True)
    learner = Learner(spec)
    for block in local_weights(weights):
        learner.load(*block)
    return Predictor(spec, learner)
