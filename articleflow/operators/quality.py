"""Validation and audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions.text import is_blank, strip

# Fixed values.
CATEGORIES = ["科技", "财经", "社会", "体育", "国内", "国际"]
STATUSES = ["pending", "processing", "completed", "failed"]
UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def categories(spark: SparkSession) -> DataFrame:
    """The fixed category list in contract order."""
    return spark.createDataFrame(
        [(name, place) for place, name in enumerate(CATEGORIES)], "category string, ord int"
    )


def valid_category(col: Column, domain: Sequence[str] = CATEGORIES) -> Column:
    return F.coalesce(col.isin(list(domain)), F.lit(False))


def article_problem(domain: Sequence[str] = CATEGORIES) -> Column:
    """The first failing rule, or null."""
    return (
        F.when(~valid_category(F.col("category"), domain), "invalid_category")
        .when(is_blank(F.col("title")) | is_blank(F.col("content")), "blank_title_or_content")
        .when(is_blank(F.col("source_url")), "blank_source_url")
    )


def split_articles(
    df: DataFrame, domain: Sequence[str] = CATEGORIES
) -> tuple[DataFrame, DataFrame]:
    """(valid articles, rejected articles with ``reason``)."""
    judged = df.withColumn("reason", article_problem(domain))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def split_client_ids(df: DataFrame, col: str = "client_id") -> tuple[DataFrame, DataFrame]:
    """(rows with a normalised UUID v4, rejected rows with ``reason``)."""
    tidy = df.withColumn(col, F.lower(strip(F.col(col)))).withColumn(
        "reason",
        F.when(F.col(col).isNull() | (F.length(col) != 36), "bad_length").when(
            ~F.col(col).rlike(UUID4), "not_uuid4"
        ),
    )
    return tidy.where("reason is null").drop("reason"), tidy.where("reason is not null")


def _excess(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; counts combine before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _named(df: DataFrame, check: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(check).alias("check"), "violations"
    )


def audit(articles: DataFrame, favorites: DataFrame, feedback: DataFrame) -> DataFrame:
    """(check, violations) for every table constraint."""
    ids = articles.select(F.col("id").alias("news_id"))
    required = ["title", "content", "category", "source", "source_url", "content_hash"]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    known = F.coalesce(F.col("summary_status").isin(STATUSES), F.lit(False))
    long = (F.length("title") > 255) | (F.length("source_url") > 1024)
    one_pass = articles.agg(
        F.count_if(missing).alias("article_not_null"),
        F.count_if(~known).alias("article_status_domain"),
        F.count_if(long).alias("article_length_limits"),
    )
    rows = one_pass.unpivot(
        [], ["article_not_null", "article_status_domain", "article_length_limits"],
        "check", "violations",
    )

    def orphans(df: DataFrame) -> DataFrame:
        """Rows without an article; counted per article first, so a hot one is a single row."""
        per_article = df.groupBy("news_id").agg(F.count(F.lit(1)).alias("n"))
        return per_article.join(ids, "news_id", "left_anti")

    def total(df: DataFrame, check: str) -> DataFrame:
        return df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
            F.lit(check).alias("check"), "violations"
        )

    checks = [
        (_excess(articles, ["content_hash"]), "article_unique_content_hash"),
        (_excess(articles, ["id"]), "article_unique_id"),
        (_excess(favorites, ["client_id", "news_id"]), "favorite_unique_client_news"),
        (_excess(feedback, ["client_id", "news_id"]), "feedback_unique_client_news"),
    ]
    counted = [_named(df, name) for df, name in checks] + [
        total(orphans(favorites), "favorite_orphans"),
        total(orphans(feedback), "feedback_orphans"),
    ]
    return reduce(DataFrame.unionByName, counted, rows)
