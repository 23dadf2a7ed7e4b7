"""Summary tasks as a table: claims, results, recovery, and the fold over the event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.operators.ordering import ordered_fold, ordered_scan

STATES = ["pending", "processing", "completed", "failed", "deleted"]
# Event -> (state it needs, state it leads to).
TRANSITIONS = {
    "claim": ("pending", "processing"),
    "complete": ("processing", "completed"),
    "fail": ("processing", "failed"),
    "request": ("failed", "pending"),
    "delete": ("processing", "deleted"),
}
ERROR_LIMIT = 500
# Fixed value: the reason that readers of failed tasks see.
STALE_REASON = "Worker 异常中断恢复：processing 滞留超过 {minutes:g} 分钟"
PENDING, PROCESSING, COMPLETED, FAILED, DELETED = range(5)


def status_view(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").alias("news_id"),
        "summary_status",
        "summary",
        F.col("summary_time_ms").alias("generation_time_ms"),
    )


def _reaches(event: Column, state: int) -> Column:
    """Index of the state after ``event`` when it meets ``state``."""
    out = F.lit(state)
    for name, (source, target) in TRANSITIONS.items():
        if STATES.index(source) == state:
            out = F.when(event == name, STATES.index(target)).otherwise(out)
    return out


def outcomes(event: Column) -> Column:
    """Array over all states: the state each one turns into."""
    return F.array(*[_reaches(event, s) for s in range(len(STATES))])


def task_segment(event: Column, seq: Column) -> Column:
    """One event as a function of the state it meets, with the rows it makes current.

    ``error`` is the failing event's number, -1 once cleared, null while untouched.
    """
    number = seq.cast("long")
    none = F.lit(None).cast("long")

    def met(state: int) -> Column:
        after = _reaches(event, state)
        moved = after != state
        return F.struct(
            after.alias("state"),
            moved.cast("long").alias("applied"),
            (~moved).cast("long").alias("ignored"),
            F.when(moved & (event == "complete"), number).otherwise(none).alias("result"),
            F.when(moved & (event == "fail"), number)
            .when(moved & event.isin("complete", "request"), F.lit(-1).cast("long"))
            .otherwise(none)
            .alias("error"),
            F.when(moved, number).otherwise(none).alias("updated"),
        )

    return F.array(*[met(s) for s in range(len(STATES))])


def merge_tasks(left: Column, right: Column) -> Column:
    """Function composition per start state; associative."""

    def then(x: Column) -> Column:
        y = F.get(right, x["state"])
        return F.struct(
            y["state"].alias("state"),
            (x["applied"] + y["applied"]).alias("applied"),
            (x["ignored"] + y["ignored"]).alias("ignored"),
            F.coalesce(y["result"], x["result"]).alias("result"),
            F.coalesce(y["error"], x["error"]).alias("error"),
            F.coalesce(y["updated"], x["updated"]).alias("updated"),
        )

    return F.transform(left, then)


def state_rows(folded: DataFrame, key: str = "task_id") -> DataFrame:
    """Read folded segments off for tasks that began as pending."""
    row = F.get("folded", PENDING)
    names = F.array(*[F.lit(s) for s in STATES])
    return folded.select(
        key,
        F.get(names, row["state"]).alias("status"),
        row["applied"].alias("applied"),
        row["ignored"].alias("ignored"),
        row["result"].alias("result_seq"),
        F.nullif(row["error"], F.lit(-1)).alias("error_seq"),
        row["updated"].alias("updated_seq"),
    )


def fold(events: DataFrame, key: str = "task_id", seq: str = "seq", width: int = 4096) -> DataFrame:
    """Current state per task from (task_id, seq, event); illegal moves change nothing."""
    segments = ordered_fold(
        events, [key], seq, task_segment(F.col("event"), F.col(seq)), merge_tasks, "folded", width
    )
    return state_rows(segments, key)


def stale_events(
    states: DataFrame, events: DataFrame, as_of: Column, minutes: int = 10, key: str = "task_id", seq: str = "seq"
) -> DataFrame:
    """A ``fail`` event for every task whose last applied event left it in processing too long ago.

    Appended to the log, they recover a continuous fold as ``recover_stale`` recovers a table; the
    clock is a parameter, so the result does not depend on when the job runs.
    """
    running = states.where("status = 'processing'").select(key, F.col("updated_seq").alias(seq))
    late = events.select(key, seq, "ts").join(running, [key, seq]).where(
        F.col("ts") < as_of - F.make_interval(mins=F.lit(minutes))
    )
    return late.select(key, F.lit("fail").alias("event"), as_of.alias("ts"), F.col(seq).alias("stale_seq"))


def ignored(events: DataFrame, key: str = "task_id", seq: str = "seq", width: int = 256) -> DataFrame:
    """The events the fold ignored, with the state they met: the warning log."""
    met = ordered_scan(events, [key], seq, outcomes(F.col("event")), PENDING, "_met", width)
    names = F.array(*[F.lit(s) for s in STATES])
    after = F.get(outcomes(F.col("event")), F.col("_met"))
    return (
        events.join(met, [key, seq])
        .where(after == F.col("_met"))
        .select(key, seq, "event", F.get(names, F.col("_met")).alias("state"))
    )


def claimable(df: DataFrame, limit: int | None = 50, ids: Sequence[int] | None = None) -> DataFrame:
    """Ids of the oldest pending rows, or of the given ones that are pending; without a limit of all of them."""
    pending = df.where("summary_status = 'pending'").select("id")
    if ids is not None:
        return pending.where(F.col("id").isin(list(ids)))
    return pending if limit is None else pending.orderBy("id").limit(limit)


def mark_claimed(df: DataFrame, chosen: DataFrame, as_of: Column) -> DataFrame:
    return _rewrite(df, chosen, {"summary_status": F.lit("processing"), "updated_at": as_of})


def claim(df: DataFrame, as_of: Column, limit: int | None = 50, ids: Sequence[int] | None = None) -> DataFrame:
    """Move the oldest pending rows (or the given ones) to processing; others are untouched."""
    return mark_claimed(df, claimable(df, limit, ids), as_of)


def _rewrite(df: DataFrame, ids: DataFrame, values: dict[str, Column]) -> DataFrame:
    marked = df.join(ids.withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.col("_hit").isNotNull()
    changed = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}
    return marked.withColumns(changed).drop("_hit").select(*df.columns)


def apply(snapshot: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Write outcomes (id, outcome ok|failed, summary, generation_time_ms, model_version, error).

    Only rows still in processing change; a failure keeps the summary fields.
    """
    given = results.select(
        "id",
        F.col("outcome").alias("_outcome"),
        F.col("summary").alias("_summary"),
        F.col("generation_time_ms").alias("_time"),
        F.col("model_version").alias("_version"),
        F.substring("error", 1, ERROR_LIMIT).alias("_error"),
    )
    joined = snapshot.join(given, "id", "left")
    running = F.col("summary_status") == "processing"
    done = F.coalesce(running & (F.col("_outcome") == "ok"), F.lit(False))
    broke = F.coalesce(running & (F.col("_outcome") == "failed"), F.lit(False))
    return joined.withColumns(
        {
            "summary": F.when(done, F.col("_summary")).otherwise(F.col("summary")),
            "summary_time_ms": F.when(done, F.col("_time").cast("int")).otherwise(F.col("summary_time_ms")),
            "model_version": F.when(done, F.col("_version")).otherwise(F.col("model_version")),
            "summary_error": F.when(broke, F.col("_error")).when(~done, F.col("summary_error")),
            "summary_status": F.when(done, "completed").when(broke, "failed").otherwise(F.col("summary_status")),
            "updated_at": F.when(done | broke, as_of).otherwise(F.col("updated_at")),
        }
    ).select(*snapshot.columns)


def request(snapshot: DataFrame, ids: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(snapshot with failed rows reset to pending, status rows of the requested ids)."""
    asked = ids.select("id").distinct()
    failed = snapshot.where("summary_status = 'failed'").select("id").join(asked, "id", "left_semi")
    renewed = _rewrite(
        snapshot,
        failed,
        {
            "summary_status": F.lit("pending"),
            "summary_error": F.lit(None).cast("string"),
            "updated_at": as_of,
        },
    )
    return renewed, status_view(renewed.join(asked, "id", "left_semi"))


def cascade(
    favorites: DataFrame, feedback: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(favourites left, feedback left, removed rows per deleted article)."""
    gone = deleted.select(F.col("id").alias("news_id"))
    dependents = favorites.select("news_id").unionByName(feedback.select("news_id"))
    per_article = dependents.groupBy("news_id").agg(F.count(F.lit(1)).alias("_n"))
    removed = gone.join(per_article, "news_id", "left").select(
        "news_id", F.coalesce("_n", F.lit(0)).alias("removed")
    )
    return (
        favorites.join(gone, "news_id", "left_anti"),
        feedback.join(gone, "news_id", "left_anti"),
        removed,
    )


def delete_unprocessable(
    articles: DataFrame, favorites: DataFrame, feedback: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The three tables without the articles, and (news_id, removed); -1 if not in processing."""
    asked = ids.select("id").distinct()
    legal = articles.where("summary_status = 'processing'").select("id").join(asked, "id", "left_semi")
    kept_favorites, kept_feedback, removed = cascade(favorites, feedback, legal)
    report = asked.select(F.col("id").alias("news_id")).join(removed, "news_id", "left").select(
        "news_id", F.coalesce("removed", F.lit(-1)).alias("removed")
    )
    return articles.join(legal, "id", "left_anti"), kept_favorites, kept_feedback, report


def recover_stale(df: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    """Rows stuck in processing for longer than the limit become failed."""
    late = (F.col("summary_status") == "processing") & (
        F.col("updated_at") < as_of - F.make_interval(mins=F.lit(minutes))
    )
    late = F.coalesce(late, F.lit(False))
    reason = F.lit(STALE_REASON.format(minutes=minutes))
    return df.withColumns(
        {
            "summary_error": F.when(late, F.substring(reason, 1, ERROR_LIMIT)).otherwise(F.col("summary_error")),
            "updated_at": F.when(late, as_of).otherwise(F.col("updated_at")),
            "summary_status": F.when(late, "failed").otherwise(F.col("summary_status")),
        }
    )


def reset_zombie(df: DataFrame, ids: DataFrame, as_of: Column, seconds: int = 60) -> DataFrame:
    """Given rows in processing without a recent update go back to pending."""
    old = F.col("updated_at").isNull() | (
        F.col("updated_at") < as_of - F.make_interval(secs=F.lit(seconds))
    )
    stuck = df.where((F.col("summary_status") == "processing") & old).select("id")
    stuck = stuck.join(ids.select("id").distinct(), "id", "left_semi")
    return _rewrite(df, stuck, {"summary_status": F.lit("pending")})


def stats(results: DataFrame) -> DataFrame:
    """Counts of a summary phase: completed, failed, deleted."""
    return results.agg(
        F.count_if(F.col("outcome") == "ok").alias("completed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "too_long").alias("deleted"),
    )
