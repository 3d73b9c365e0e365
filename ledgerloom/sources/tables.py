"""Tables as Parquet, by folder and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet file or folder `<folder>/<name>.parquet`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
