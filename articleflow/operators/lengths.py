"""Length domains and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.operators.stats import distribution

LIMIT = 512


def eligible(df: DataFrame, limit: int = LIMIT, col: str = "token_count") -> DataFrame:
    """Rows short enough for the model; the limit itself is allowed."""
    return df.where(F.col(col) <= limit)


def domain(col: Column, limit: int = LIMIT) -> Column:
    """Strictly below, exactly at, or above the limit."""
    return (
        F.when(col < limit, f"lt{limit}").when(col == limit, f"eq{limit}").when(col > limit, f"gt{limit}")
    )


def eligibility(df: DataFrame, limit: int = LIMIT, col: str = "token_count") -> DataFrame:
    """(full, eligible, excluded, ratio); the ratio of an empty table is 0."""
    counted = df.agg(
        F.count(F.lit(1)).alias("full_count"),
        F.count_if(F.col(col) <= limit).alias("eligible_count"),
    )
    return counted.select(
        "full_count",
        "eligible_count",
        (F.col("full_count") - F.col("eligible_count")).alias("excluded_count"),
        F.coalesce(F.try_divide("eligible_count", "full_count"), F.lit(0.0)).alias("eligible_ratio"),
    )


def domain_counts(df: DataFrame, by: str, limit: int = LIMIT, col: str = "token_count") -> DataFrame:
    """Per split: rows, and count and ratio of each domain."""
    kind = domain(F.col(col), limit)
    names = [f"lt{limit}", f"eq{limit}", f"gt{limit}"]
    counted = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(kind == n).alias(f"{n}_count") for n in names]
    )
    return counted.withColumns({f"{n}_ratio": F.col(f"{n}_count") / F.col("rows") for n in names})


def domain_stats(
    df: DataFrame, by: str, metrics: list[str], limit: int = LIMIT, col: str = "token_count"
) -> DataFrame:
    """Distributions per split over all rows and over the rows below the limit."""
    scopes = F.when(F.col(col) < limit, F.array(F.lit("all"), F.lit(f"lt{limit}"))).otherwise(
        F.array(F.lit("all"))
    )
    return distribution(df.withColumn("scope", F.explode(scopes)), metrics, [by, "scope"], extended=True)
