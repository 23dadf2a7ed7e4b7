"""Sinks that refuse to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame


def jsonl(df: DataFrame, path: str) -> None:
    """One compact UTF-8 object per line."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
