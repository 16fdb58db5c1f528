"""Measures of predictions against labels, each one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.losses import logloss
from ..storage import stored


def mean_logloss(scored: DataFrame) -> DataFrame:
    """logloss of label, prediction."""
    return scored.where(F.col("label").isNotNull()).agg(F.avg(logloss(F.col("prediction"), F.col("label"))).alias("logloss"))


def confusion(scored: DataFrame, threshold: float = 0.5, eps: float = 10e-8) -> DataFrame:
    """Counts at a threshold, and precision, recall, f1, specificity, balanced accuracy, logloss with eps."""
    yes, p = F.col("label") == 1, F.col("prediction")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = scored.where(F.col("label").isNotNull()).agg(
        count(yes & (p >= threshold)).alias("tp"),
        count(~yes & (p >= threshold)).alias("fp"),
        count(yes & (p < threshold)).alias("fn"),
        count(~yes & (p < threshold)).alias("tn"),
        F.avg(-F.when(yes, F.log(p + eps)).otherwise(F.log(1 - p + eps))).alias("logloss"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    out = sums.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn"), "specificity": ratio("tn", "fp")})
    return out.withColumns({"f1": F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2})


def distinct_predictions(scored: DataFrame) -> DataFrame:
    """n, distinct_n: constant predictions are a sign of a broken model."""
    return scored.agg(F.count("*").alias("n"), F.count_distinct("prediction").alias("distinct_n"))


def running_loss(scored: DataFrame, order: str = "example_num", by: str | None = None) -> DataFrame:
    """example_num, loss, mean_loss: progressive validation. An extension; in order, within groups where a column names them.

    Without groups, rows are dealt by ranges of the order; sums of the ranges before,
    a row for each, are added to the sums within a range.
    """
    rows = scored.where(F.col("label").isNotNull()).withColumn("loss", logloss(F.col("prediction"), F.col("label")))
    if by:
        window = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select(by, order, "loss", F.avg("loss").over(window).alias("mean_loss"))
    ranged = stored(rows.select(order, "loss").repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranged")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are ranges
    before = ranged.groupBy("part").agg(F.sum("loss").alias("s"), F.count("*").alias("n"))
    before = before.select("part", F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    window = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mean = (F.col("s") + F.sum("loss").over(window)) / (F.col("n") + F.count("*").over(window))
    return ranged.join(F.broadcast(before), "part").select(order, "loss", mean.alias("mean_loss"))
