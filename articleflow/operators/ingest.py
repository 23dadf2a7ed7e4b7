"""Ingest: hash, keep the first copy, match against stored articles, count outcomes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions.text import sha256
from articleflow.operators.ordering import position
from articleflow.operators.quality import article_problem
from articleflow.session import fresh_path


def fetch_sources(spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]]) -> tuple[list[DataFrame], dict[str, str]]:
    """Rows of every source that can be read, and the error of each that cannot.

    Spark reads lazily, so each source is written to the shared folder as a unit of its own; a broken one
    then cannot void the others.
    """
    loaded, failed = [], {}
    for name, load in loaders.items():
        try:
            rows, path = load(), fresh_path(spark, "fetched")
            rows.write.parquet(path)
            loaded.append(spark.read.schema(rows.schema).parquet(path))
        except Exception as problem:  # a source's failure is its outcome
            failed[name] = f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}"
    return loaded, failed


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources with the one schema, in order: ``fetch`` numbers them, as each counts ``seq`` by itself."""
    if not sources:
        raise ValueError("no source was read")
    return reduce(DataFrame.unionByName, (df.withColumn("fetch", F.lit(n)) for n, df in enumerate(sources)))


def place(df: DataFrame, seq: str = "seq") -> list[str]:
    """The columns that identify an arrival, in order."""
    return ["fetch", seq] if "fetch" in df.columns else [seq]


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", sha256(F.col("content")))


def first_copies(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(content_hash, first_seq, copies), with first_fetch for several sources: hashes only, combined before the shuffle."""
    keys = place(df, seq)
    if len(keys) == 1:  # a number alone is combined by hash, a pair of them needs a sort
        return df.groupBy("content_hash").agg(F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("copies"))
    found = df.groupBy("content_hash").agg(F.min(F.struct(*keys)).alias("_first"), F.count(F.lit(1)).alias("copies"))
    names = ["first_seq" if k == seq else f"first_{k}" for k in keys]
    return found.select("content_hash", *(F.col(f"_first.{k}").alias(n) for k, n in zip(keys, names)), "copies")


def _winners(df: DataFrame, seq: str) -> DataFrame:
    """The places of the first copies."""
    keys = place(df, seq)
    names = ["first_seq" if k == seq else f"first_{k}" for k in keys]
    found = first_copies(df.select("content_hash", *keys), seq)
    return found.select("content_hash", *(F.col(n).alias(k) for k, n in zip(keys, names)))


def first_by_hash(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Keep the first copy of every content in arrival order.

    Winners are found on (hash, seq) alone, so the bodies of copies are never sorted or grouped.
    """
    return df.join(_winners(df, seq), place(df, seq), "left_semi")


def match(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles not stored yet, stored articles the others are copies of)."""
    known = existing.select("content_hash")
    fresh = new.join(known, "content_hash", "left_anti")
    hashes = new.select("content_hash").distinct()
    return fresh, existing.join(hashes, "content_hash", "left_semi")


def outcomes(df: DataFrame, existing: DataFrame, domain, seq: str = "seq") -> DataFrame:
    """Each fetched article with ``outcome``: created, deduped or rejected (with reason).

    Only identifiers and hashes are shuffled.
    """
    keys = place(df, seq)
    judged = with_hash(df.withColumn("reason", article_problem(domain))).select(
        *keys, "source", "reason", "content_hash"
    )
    valid = judged.where("reason is null")
    stored = existing.select("content_hash").distinct()
    created = _winners(valid, seq).join(stored, "content_hash", "left_anti")
    created = created.select(*keys, F.lit(True).alias("_created"))
    return judged.join(created, keys, "left").select(
        *keys,
        "source",
        "reason",
        "content_hash",
        F.when(F.col("reason").isNotNull(), "rejected")
        .when(F.col("_created"), "created")
        .otherwise("deduped")
        .alias("outcome"),
    )


def stats(outcome_rows: DataFrame) -> DataFrame:
    """Per source: fetched, created, deduped, rejected."""
    return outcome_rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"),
        *[
            F.count_if(F.col("outcome") == name).alias(name)
            for name in ("created", "deduped", "rejected")
        ],
    )


def append(new: DataFrame, existing: DataFrame, as_of: Column, seq: str = "seq", width: int = 100_000) -> DataFrame:
    """The next table snapshot: stored rows plus the new ones with ids and defaults.

    Ids continue after the greatest stored one, in arrival order, without a single-task window.
    """
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last")).scalar()
    keys = place(new, seq)
    step = F.floor(F.col(seq) / width)
    bucket = F.struct(F.col("fetch"), step.alias("step")) if len(keys) > 1 else step
    ranked = position(new.withColumn("_all", F.lit(0)), ["_all"], [F.col(k) for k in keys], bucket, "_pos")
    rows = ranked.select(
        (last + F.col("_pos")).alias("id"),
        "title",
        "content",
        F.lit(None).cast("string").alias("summary"),
        "category",
        "source",
        "source_url",
        "content_hash",
        "publish_time",
        as_of.alias("crawl_time"),
        F.lit("pending").alias("summary_status"),
        F.lit(None).cast("int").alias("summary_time_ms"),
        F.lit(None).cast("string").alias("summary_error"),
        F.lit(None).cast("string").alias("model_version"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
    return existing.unionByName(rows)
