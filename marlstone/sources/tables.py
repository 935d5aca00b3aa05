"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name``, one parquet file or a directory of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
