"""Predictions over a stream of lines, with models replaced between micro-batches.

Data lines become predictions, lines that can't be parsed become `ERR: ...` rows,
and a command acts on the lines after it, in the order of example_num. Scoring keeps
no state, so that append mode without a watermark is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import featurize
from ..operators.learn import score_local, sequential
from ..sources import model_store
from ..sources.text import parse


class Server:
    """A model that answers lines, and is replaced by hogwild_load commands or by a pointer file that names another one."""

    def __init__(self, spark: SparkSession, model_path: str, pointer: str | None = None):
        self.spark, self.pointer = spark, pointer
        self.path = model_path
        self.spec, self.weights = model_store.load(spark, model_path, immutable=True)

    def load(self, path: str) -> str:
        """The answer to a hogwild_load command. A model of another specification is refused."""
        try:
            spec, weights = model_store.load(self.spark, path, immutable=True, like=None)
            if spec.to_json() != self.spec.to_json():
                raise ValueError("another specification")
        except Exception:  # any unreadable model: the one in use stays, and the caller is told
            return "ERR: hogwild_load fail"
        self.path, self.spec, self.weights = path, spec, weights
        return "hogwild_load success"

    def poll(self) -> None:
        """Follows the pointer file, if there is one."""
        if self.pointer:
            named = self.spark.read.text(self.pointer).first()
            if named is not None and named.value.strip() not in ("", self.path):
                self.load(named.value.strip())

    def answer(self, lines: DataFrame) -> DataFrame:
        """example_num, response of example_num, line: a prediction of six decimals, an error, or a command's answer. Lines between two commands are scored together."""
        self.poll()
        parsed = parse(lines, self.spec.catalog)
        bad = parsed.where("error is not null").select("example_num", F.concat(F.lit("ERR: "), "error").alias("response"))
        data = parsed.where("error is null and command is null")
        # Commands are few: control lines between data.
        commands = parsed.where("command = 'hogwild_load'").select("example_num", "argument").orderBy("example_num").collect()
        out, answers, after = bad, [], None
        for row in [*commands, None]:
            own = data if after is None else data.where(F.col("example_num") > after)
            own = own if row is None else own.where(F.col("example_num") < row.example_num)
            scored = score_local(featurize(own, self.spec), self.spec, self.weights)
            out = out.union(scored.select("example_num", F.format_string("%.6f", "prediction").alias("response")))
            if row is not None:
                after = row.example_num
                answers.append((after, self.load(row.argument)))
        return out.union(self.spark.createDataFrame(answers, "example_num long, response string")) if answers else out


def serve(lines: DataFrame, server: Server, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Answers a stream of example_num, line by micro-batches into a sink."""
    writer = lines.writeStream.foreachBatch(lambda batch, number: sink(server.answer(batch), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def learn_stream(features: DataFrame, spec, model_dir: str, checkpoint: str, once: bool = False) -> StreamingQuery:  # noqa: ANN001
    """Learns a stream of features in the order of example_num within micro-batches. Each batch's weights are a model of its own, model_dir/<batch>; a batch that runs again starts from the one before it and gives the same model."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start = model_store.load(spark, f"{model_dir}/{number - 1}")[1] if number else None
        predictions, weights = sequential(batch, spec, start)
        predictions.write.mode("overwrite").parquet(f"{model_dir}/predictions/batch={number}")
        model_store.save(spec, weights, f"{model_dir}/{number}")

    writer = features.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of event_type, ts, value in windows of event time; works on streams too. An extension."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
