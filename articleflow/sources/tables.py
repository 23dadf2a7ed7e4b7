"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from articleflow.session import spread
from articleflow.sources.schemas import TABLES


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan one table; known tables get their fixed schema, so no inference runs."""
    path = f"{directory.rstrip('/')}/{name}.parquet"
    reader = spark.read
    if name in TABLES:
        reader = reader.schema(TABLES[name])
    return reader.parquet(path)


def read_spread(spark: SparkSession, directory: str, name: str, key: str) -> DataFrame:
    """Scan for CPU-heavy work per row: a table of few splits is spread over the cores by key."""
    return spread(read(spark, directory, name), key)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A new immutable version of a table; an existing version is never overwritten."""
    df.write.mode("errorifexists").parquet(path)
