"""Readers for landed Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` under `folder`, by any path that Spark can read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
