"""Raw pages come from a table (page_id, url, html), not from the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from articleflow.sources import tables


def read(spark: SparkSession, directory: str) -> DataFrame:
    return tables.read_spread(spark, directory, "pages", "page_id")
