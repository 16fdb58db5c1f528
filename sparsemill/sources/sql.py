"""A model as a function of SQL: a line in, its prediction out."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.learn import LOCAL_WEIGHTS, batch_predictions, local_weights, scorer_of
from .local import Predictor
from .model_store import load
from .vector import feature_lists, parse_lines


def register(spark: SparkSession, path: str, name: str = "predict") -> None:
    """Makes a model's predictions callable as `name(line)`; -1.0 for null and for lines that can't be parsed, or are commands. The model travels to every task and may have LOCAL_WEIGHTS weights."""
    spec, weights = load(spark, path, immutable=True)
    if weights.count() > LOCAL_WEIGHTS:
        raise ValueError("too large a model for every task: use score_joined")
    loaded, key, wanted = local_weights(weights), uuid.uuid4().hex, spec.used_columns()

    def predictions(lines: pa.Array) -> np.ndarray:
        model = scorer_of(key, spec, loaded)
        if spec.layers or spec.transforms:
            single = Predictor(spec, model)
            return np.array([-1.0 if x is None else single.predict(x) for x in lines.to_pylist()])
        state, every = parse_lines(lines, spec.catalog, wanted)
        batch = pa.RecordBatch.from_arrays(feature_lists(every, spec, len(lines)), ["lr", "ffm"])
        good = np.asarray(state["error"].is_null()) & np.asarray(state["command"].is_null()) & np.asarray(lines.is_valid())
        return np.where(good, batch_predictions(model, batch), -1.0)

    @F.arrow_udf("double")
    def predict(lines: pa.Array) -> pa.Array:
        return pa.array(predictions(lines), pa.float64())

    spark.udf.register(name, predict)
