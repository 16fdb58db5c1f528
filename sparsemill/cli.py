"""The command line: train, predict, convert, cache and serve."""

from __future__ import annotations

import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.losses import prediction_line
from .operators.features import featurize
from .operators.learn import averaged, score_local, sequential
from .plans.spec import SpecError, _or, from_options, parser
from .sources import cache, model_store, vector
from .sources.catalog import Catalog
from .sources.text import read_lines


def write_predictions(predictions: DataFrame, path: str) -> None:
    """One number of six decimals a line, in the order of example_num, in one file: the format is a single ordered file."""
    lines = predictions.repartitionByRange("example_num").sortWithinPartitions("example_num").select(prediction_line().alias("value"))
    partial = f"{path}.writing"
    with open(partial, "w", encoding="ascii") as out:
        for row in lines.toLocalIterator(prefetchPartitions=True):  # a partition at a time
            out.write(f"{row.value}\n")
    os.replace(partial, path)


def run(spark: SparkSession, args: Sequence[str]) -> DataFrame | None:
    """Predictions (example_num, prediction), or None where nothing is predicted."""
    o = parser().parse_args(list(args))
    if o.final_regressor and not o.save_resume:
        raise SpecError("You need to use --save_resume with --final_regressor, for now")
    if o.holdout_after is not None and o.testonly:
        raise SpecError("--holdout_after can not be used with --testonly")
    if o.convert_inference_regressor:
        if o.adaptive:
            raise SpecError("--convert_inference_regressor can not be used with --adaptive")
        model_store.convert_to_inference(spark, o.initial_regressor, o.convert_inference_regressor, o.weight_quantization)
        return None
    if o.daemon:
        return _serve(spark, o)
    if not o.data:
        raise SpecError("No data: give --data")
    start = None
    if o.initial_regressor:
        spec, start = model_store.load(spark, o.initial_regressor, o.testonly, **{name: getattr(o, name) for name in model_store.OVERRIDES})
    else:
        spec = from_options(o, Catalog.read(os.path.dirname(o.data) or "."))
    cached = o.cache or o.build_cache_without_training
    if cached or spec.transforms:
        examples = cache.examples(spark, o.data, spec.catalog, cached)
    else:
        examples = vector.featurize(read_lines(spark, o.data), spec)
    if o.build_cache_without_training:
        return None
    broken = examples.where("error is not null").select("error").first()
    if broken is not None:
        raise ValueError(broken.error)
    rows = examples.where("command is null")
    features = featurize(rows, spec) if spec.transforms else vector.featurize_examples(rows, spec) if cached else rows
    shown = F.col("example_num") > (o.predictions_after or 0)
    if o.testonly:
        weights = start
        predictions = score_local(features, spec, start) if start is not None else score_local(features, spec, _nothing(spark))
        predictions = predictions.where(shown)
    elif o.hogwild_training:
        weights = averaged(features, spec, o.hogwild_threads or 16)
        # Parallel learning has no prediction that precedes the update.
        predictions = features.select("example_num", F.lit(None).cast("double").alias("prediction")).where(shown)
    else:
        predictions, weights = sequential(features, spec, start, predictions_after=o.predictions_after or 0, holdout_after=o.holdout_after, delay=o.prediction_model_delay or 0)
    if o.predictions:
        write_predictions(predictions, o.predictions)
    if o.predictions_stdout:
        for row in predictions.repartitionByRange("example_num").sortWithinPartitions("example_num").select(prediction_line().alias("value")).toLocalIterator():
            sys.stdout.write(f"{row.value}\n")
    if o.final_regressor:
        model_store.save(spec, weights, o.final_regressor, o.weight_quantization)
    return predictions


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "block string, idx long, w float, acc float")


def _serve(spark: SparkSession, o) -> None:  # noqa: ANN001
    """Answers the lines of each client until it is stopped."""
    from .streaming.daemon import Daemon

    daemon = Daemon(lambda path: model_store.predictor(spark, path), o.initial_regressor, port=_or(o.port, 26542), children=_or(o.num_children, 10))
    with daemon:
        daemon.serve_forever()


def main() -> None:
    spark = SparkSession.builder.appName("sparsemill").getOrCreate()
    try:
        run(spark, sys.argv[1:])
    except (SpecError, ValueError) as e:
        sys.exit(str(e))


if __name__ == "__main__":
    main()
