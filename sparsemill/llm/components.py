"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def star_forest(edges: DataFrame, order: str = "long") -> DataFrame:
    """a, b for each node a that isn't its component's smallest node b. edges: columns a and b, any direction, repeats allowed.

    Every round hangs neighbours on the smallest node they see, which takes about
    log(nodes) rounds. A node's minimum is stored before it meets the node's edges,
    so that a node with very many edges is a skewed join of two plain shuffles.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        # Large star: each node's larger neighbours go to the smallest of all it sees.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
        large = stored(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = stored(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        rest = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = stored(low.select("a", F.col("low").alias("b")).union(rest).distinct(), "edges")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last:
            return now
        last = mark
