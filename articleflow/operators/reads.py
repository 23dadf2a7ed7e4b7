"""Read queries: pages of articles, details, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.operators.quality import CATEGORIES
from articleflow.operators.users import state

LIST_COLUMNS = ["id", "title", "summary", "category", "source", "publish_time", "summary_status"]
MAX_PAGE_SIZE = 50


def list_columns(df: DataFrame) -> DataFrame:
    """The seven list columns; the body is never read."""
    return df.select(*LIST_COLUMNS)


def by_id(df: DataFrame, news_id: int) -> DataFrame:
    return df.where(F.col("id") == news_id)


def by_category(df: DataFrame, category: str | None) -> DataFrame:
    return df if category is None else df.where(F.col("category") == category)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def page(
    df: DataFrame,
    number: int = 1,
    size: int = 20,
    category: str | None = None,
    domain: Sequence[str] = CATEGORIES,
) -> DataFrame:
    """One stable page: newest first, undated last, then id descending.

    Adds ``total`` and ``has_more``. The page is a top-k, the total one aggregated row.
    """
    if number < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page size must be between 1 and {MAX_PAGE_SIZE}")
    if category is not None and category not in domain:
        raise ValueError(f"unknown category: {category}")
    rows = by_category(df, category)
    skipped = (number - 1) * size
    top = (
        list_columns(rows)
        .orderBy(F.col("publish_time").desc_nulls_last(), F.col("id").desc())
        .offset(skipped)
        .limit(size)
    )
    # One projection: a second one on top of the subquery would hide the top-k from the planner.
    matching = total(rows).scalar()
    return top.select("*", matching.alias("total"), (matching > skipped + size).alias("has_more"))


def detail(
    articles: DataFrame,
    favorites: DataFrame,
    feedback: DataFrame,
    news_id: int | None = None,
    client_id: str | None = None,
) -> DataFrame:
    """Articles with the client's state; no client gives (false, null)."""
    rows = articles if news_id is None else by_id(articles, news_id)
    columns = [
        "id", "title", "content", "summary", "category", "source", "source_url",
        "publish_time", "summary_status", "summary_time_ms",
    ]
    if client_id is None:
        return rows.select(
            *columns,
            F.lit(False).alias("is_favorite"),
            F.lit(None).cast("boolean").alias("feedback"),
        )
    asked = rows.withColumn("client_id", F.lit(client_id)).withColumnRenamed("id", "news_id")
    return state(asked, favorites, feedback).withColumnRenamed("news_id", "id").select(
        *columns, "is_favorite", "feedback"
    )


def counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
