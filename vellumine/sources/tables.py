"""Readers of the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name below sf_dir, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
