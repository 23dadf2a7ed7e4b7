"""Favourites and feedback: folds over interaction logs, lists and per-article state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.operators.ordering import ordered_fold

PAIR = ["client_id", "news_id"]


def split_known(interactions: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(interactions with an existing article, the rest)."""
    ids = articles.select(F.col("id").alias("news_id"))
    return (
        interactions.join(ids, "news_id", "left_semi"),
        interactions.join(ids, "news_id", "left_anti"),
    )


def favorite_segment(action: Column, seq: Column, ts: Column) -> Column:
    """What one event does: whether it clears, and the favourite it leaves standing."""
    added = F.when(action == "add", F.struct(seq.cast("long").alias("seq"), ts.alias("ts")))
    return F.struct((action == "remove").alias("clears"), added.alias("standing"))


def merge_favorites(left: Column, right: Column) -> Column:
    """A later clear wins; otherwise the earliest standing add does."""
    return F.struct(
        (left["clears"] | right["clears"]).alias("clears"),
        F.when(right["clears"], right["standing"])
        .otherwise(F.coalesce(left["standing"], right["standing"]))
        .alias("standing"),
    )


def fold_favorites(events: DataFrame, seq: str = "seq", width: int = 4096) -> DataFrame:
    """Current favourites from (client_id, news_id, action add|remove, seq, ts).

    Adding twice keeps the first time; adding after a removal takes the new time.
    """
    moves = events.where(F.col("action").isin("add", "remove"))
    folded = ordered_fold(
        moves, PAIR, seq,
        favorite_segment(F.col("action"), F.col(seq), F.col("ts")),
        merge_favorites, "f", width,
    )
    return folded.where("f.standing is not null").select(
        *PAIR, F.col("f.standing.seq").alias("id"), F.col("f.standing.ts").alias("created_at")
    )


def fold_feedback(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Current feedback from (client_id, news_id, helpful, seq, ts): last value, first and last time."""
    return (
        events.where(F.col("helpful").isNotNull())
        .groupBy(*PAIR)
        .agg(
            F.min_by("ts", seq).alias("created_at"),
            F.max_by("ts", seq).alias("updated_at"),
            F.max_by("helpful", seq).alias("helpful"),
        )
    )


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Latest row per key: one struct per key and map task reaches the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, "_row.*")
    )


def favorites(fav: DataFrame, articles: DataFrame, client: str | None = None) -> DataFrame:
    """Favourites with the list columns, newest first for one client; without bodies.

    Article ids are unique, so a hot article only makes skewed partitions of ``fav``, which
    adaptive execution splits.
    """
    rows = fav if client is None else fav.where(F.col("client_id") == client)
    listed = articles.select(
        F.col("id").alias("news_id"), "title", "summary", "category", "source", "publish_time",
        "summary_status",
    )
    joined = rows.select(*PAIR, "created_at", F.col("id").alias("favorite_id")).join(listed, "news_id")
    if client is None:
        return joined
    return joined.orderBy(F.col("created_at").desc(), F.col("favorite_id").desc())


def state(pairs: DataFrame, fav: DataFrame, feedback: DataFrame) -> DataFrame:
    """Add ``is_favorite`` and ``feedback`` (null: none) to rows with (client_id, news_id)."""
    liked = fav.select(*PAIR, F.lit(True).alias("_liked"))
    said = feedback.select(*PAIR, F.col("helpful").alias("feedback"))
    return (
        pairs.join(liked, PAIR, "left")
        .join(said, PAIR, "left")
        .withColumn("is_favorite", F.col("_liked").isNotNull())
        .drop("_liked")
    )
