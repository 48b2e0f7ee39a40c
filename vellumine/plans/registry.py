"""The named queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumine.plans import blocks, candidates, documents, evidence, profiles, records, relational, saves, stats, texts

MODULES = (stats, relational, texts, documents, profiles, candidates, saves, blocks, evidence, records)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent terms of the documents beside the order counts by status."""
    return stats.flagship(spark, sf_dir)
