"""Continuous ingest, task and interaction folds, and windowed counts.

Folds keep a log of small pre-folded segments, one folder per micro-batch, instead of one task per
key: a micro-batch folds its events with map-side buckets, a replayed batch overwrites its own
folder, and the state is the fold of the log.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from articleflow.operators import ingest as ingest_ops
from articleflow.operators import tasks, users
from articleflow.operators.extract import SourceConfig, examine
from articleflow.operators.ordering import Merge, ordered_fold
from articleflow.operators.quality import article_problem
from articleflow.streaming.content_index import ContentIndex


def read(
    spark: SparkSession, directory: str, name: str, schema: StructType | str, files_per_batch: int = 16
) -> DataFrame:
    """Micro-batches of the parquet files of one table: files of its name, or those in a folder of its name."""
    folder = re.sub(r"([\\{}\[\]*?])", r"\\\1", directory.rstrip("/"))  # only the name may match by pattern
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{name}*.parquet")
    )


def _drain(writer, path: str) -> None:
    """Process all available input; progress lives next to the output."""
    query = writer.option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()


def append_to(stream: DataFrame, path: str) -> str:
    """Append finished rows to a parquet folder."""
    _drain(stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows"), path)
    return f"{path}/rows"


def each_batch(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    _drain(stream.writeStream.foreachBatch(write).outputMode(mode), path)


def dedupe(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First row per key within the watermark; state older than the delay is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def ingest(
    pages: DataFrame, cfg: SourceConfig, as_of: Column, path: str, domain, stored: DataFrame | None = None
) -> DataFrame:
    """Pages to new articles, each content once; returns the written articles.

    A batch keeps first copies, then drops contents of the stored table and of earlier batches, which it looks up in
    a ``ContentIndex``: only the buckets of its own hashes are read, however many batches there were. The first copy is
    the one of smallest ``seq``, also where its file comes later: it is written too, and the article is the first written.
    """
    spark = pages.sparkSession
    folder = f"{path}/articles"
    index = ContentIndex(spark, f"{path}/index")

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = examine(batch, cfg, as_of).where("reject_reason is null").select(
            F.col("page_id").alias("seq"), "title", "content", "category",
            F.lit(cfg.name).alias("source"), F.col("url").alias("source_url"), "publish_time",
        )
        valid = ingest_ops.with_hash(seen.where(article_problem(domain).isNull())).persist()
        fresh = ingest_ops.first_by_hash(valid)
        if stored is not None:
            fresh = fresh.join(stored.select("content_hash"), "content_hash", "left_anti")
        fresh = index.unknown(fresh, batch_id)
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        index.add(spark.read.schema(fresh.schema).parquet(f"{folder}/batch={batch_id}"), batch_id)
        valid.unpersist()

    each_batch(pages, path, write)
    return ingest_ops.first_by_hash(spark.read.parquet(folder))


def fold_log(
    stream: DataFrame, keys: Sequence[str], seq: str, segment: Column, merge: Merge, path: str
) -> DataFrame:
    """Write one segment per key and micro-batch; returns the log (keys, folded, batch)."""
    folder = f"{path}/segments"

    def write(batch: DataFrame, batch_id: int) -> None:
        folded = ordered_fold(batch, keys, seq, segment, merge)
        folded.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    each_batch(stream, path, write)
    return stream.sparkSession.read.parquet(folder)


def current(log: DataFrame, keys: Sequence[str], merge: Merge) -> DataFrame:
    """Fold a segment log in batch order: arrival order decides, late events meet the guard."""
    return ordered_fold(log, keys, "batch", F.col("folded"), merge)


def compact(log: DataFrame, keys: Sequence[str], merge: Merge, path: str) -> DataFrame:
    """Write a log as one segment per key, dated with its last batch; read on from there.

    Merging is associative, so later batches can be added to the compacted log as to the full one.
    """
    last = log.agg(F.max("batch")).scalar()
    current(log, keys, merge).withColumn("batch", last).write.mode("errorifexists").parquet(path)
    return log.sparkSession.read.parquet(path)


def task_states(stream: DataFrame, path: str, key: str = "task_id") -> DataFrame:
    """Task states from a stream of (task_id, seq, event); a retry is a request event."""
    log = fold_log(
        stream, [key], "seq", tasks.task_segment(F.col("event"), F.col("seq")), tasks.merge_tasks, path
    )
    return tasks.state_rows(current(log, [key], tasks.merge_tasks), key)


def favorite_states(stream: DataFrame, path: str) -> DataFrame:
    """Favourites from a stream of (client_id, news_id, action, seq, ts)."""
    moves = stream.where(F.col("action").isin("add", "remove"))
    segment = users.favorite_segment(F.col("action"), F.col("seq"), F.col("ts"))
    log = fold_log(moves, users.PAIR, "seq", segment, users.merge_favorites, path)
    folded = current(log, users.PAIR, users.merge_favorites)
    return folded.where("folded.standing is not null").select(
        *users.PAIR,
        F.col("folded.standing.seq").alias("id"),
        F.col("folded.standing.ts").alias("created_at"),
    )


def feedback_states(stream: DataFrame, path: str) -> DataFrame:
    """Feedback from a stream of (client_id, news_id, helpful, seq, ts)."""
    spark = stream.sparkSession
    folder = f"{path}/feedback"

    def write(batch: DataFrame, batch_id: int) -> None:
        users.fold_feedback(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    each_batch(stream, path, write)
    return (
        spark.read.parquet(folder)
        .groupBy(*users.PAIR)
        .agg(
            F.min_by("created_at", "batch").alias("created_at"),
            F.max_by("updated_at", "batch").alias("updated_at"),
            F.max_by("helpful", "batch").alias("helpful"),
        )
    )


def window_stats(
    stream: DataFrame, ts: str, kind: str, size: str, slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Counts per tumbling or sliding window and kind; a window closes behind the watermark."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (
        stream.withWatermark(ts, delay)
        .groupBy(span.alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n")
    )


def open_windows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The windows of a drained ``window_stats`` query that the watermark has not closed, from the query's own state."""
    state = spark.read.format("statestore").load(f"{path}/_progress")
    window = F.col("key.window")
    return state.select(
        window["start"].alias("window_start"), window["end"].alias("window_end"), F.col(f"key.{kind}").alias(kind), F.col("value.count").alias("n")
    )


def all_windows(stream: DataFrame, path: str, kind: str) -> DataFrame:
    """Drain a ``window_stats`` stream: its closed windows and the open ones, so every event that was not late is counted."""
    spark = stream.sparkSession
    closed = spark.read.schema(stream.schema).parquet(append_to(stream, path))
    return closed.unionByName(open_windows(spark, path, kind))


def session_stats(stream: DataFrame, ts: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Counts per activity session of a key."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")
    )


def open_sessions(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The sessions of a drained ``session_stats`` query that may still grow."""
    state = spark.read.format("statestore").load(f"{path}/_progress")
    span = F.col("value.session_window")
    return state.select(span["start"].alias("session_start"), span["end"].alias("session_end"), F.col(f"key.{key}").alias(key), F.col("value.count").alias("n"))


def all_sessions(stream: DataFrame, path: str, key: str) -> DataFrame:
    """Drain a ``session_stats`` stream: its closed sessions and the open ones."""
    spark = stream.sparkSession
    closed = spark.read.schema(stream.schema).parquet(append_to(stream, path))
    return closed.unionByName(open_sessions(spark, path, key))
