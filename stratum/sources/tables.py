"""Tables as the engine's queries read them: Parquet folders or files, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table of that name in a folder of any file system that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
