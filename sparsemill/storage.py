"""Tables that are computed once and read back from the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a single machine without it a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_sparsemill_dir", None)
        if not found:
            found = spark._sparsemill_dir = tempfile.mkdtemp(prefix="sparsemill-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from Parquet in the shared folder: cuts lineage, and survives the loss of executors. It stays until release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark._sparsemill_stored = [*getattr(spark, "_sparsemill_stored", []), path]
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes what stored() has written for this session so far, and says how many tables that were. For the session's owner, once results that read them are written."""
    paths = getattr(spark, "_sparsemill_stored", [])
    spark._sparsemill_stored = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
