"""Table access: one Parquet dataset per table under a root folder or URI."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read ``root/name.parquet`` (a file or a folder) through Spark's own reader,
    so that any file system Spark knows can hold it."""
    return spark.read.parquet(f"{root}/{name}.parquet")
