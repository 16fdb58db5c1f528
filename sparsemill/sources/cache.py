"""Parsed examples, kept as Parquet beside a fingerprint of what they were parsed with."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog
from .text import read_lines
from .vector import parse

VERSION = 1


def cache_path(data_path: str) -> str:
    return f"{data_path}.examples"


def _fingerprint(catalog: Catalog) -> str:
    return json.dumps({"version": VERSION, "catalog": json.loads(catalog.to_json())}, sort_keys=True)


def read_fingerprint(spark: SparkSession, path: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.text(f"{path}/fingerprint", wholetext=True).collect()
    except AnalysisException:  # there is none
        return None
    return found[0].value if found else None


def write(examples: DataFrame, catalog: Catalog, path: str) -> None:
    """The fingerprint comes last: an interrupted write leaves no valid cache."""
    spark = examples.sparkSession
    examples.write.mode("overwrite").parquet(f"{path}/examples")
    spark.createDataFrame([(_fingerprint(catalog),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/fingerprint")


def valid(spark: SparkSession, catalog: Catalog, path: str) -> bool:
    found = read_fingerprint(spark, path)
    return found is not None and found.strip() == _fingerprint(catalog)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/examples")


def examples(spark: SparkSession, data_path: str, catalog: Catalog, use_cache: bool = False) -> DataFrame:
    """Examples of a text file; with a cache, from it, and first into it where it's missing or of another catalog."""
    if not use_cache:
        return parse(read_lines(spark, data_path), catalog)
    path = cache_path(data_path)
    if not valid(spark, catalog, path):
        write(parse(read_lines(spark, data_path), catalog), catalog, path)
    return read(spark, path)
