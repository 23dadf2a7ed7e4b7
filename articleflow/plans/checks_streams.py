"""Streaming jobs over the given tables, drained once, equal to their batch form."""

from pyspark.sql import functions as F

from articleflow.functions.text import sha256
from articleflow.operators import ingest, users
from articleflow.plans.catalogue import query
from articleflow.plans.checks_pages import PARAGRAPH_SQL, SITE, TITLE_SQL
from articleflow.plans.checks_tasks import FOLD_SQL, plain_states
from articleflow.plans.checks_text import ENDERS, WORDS
from articleflow.plans.jobs import run_round
from articleflow.plans.mapping import (
    INTERACTIONS_SQL,
    as_of,
    document_articles,
    interactions,
    stamp,
)
from articleflow.session import fresh_path
from articleflow.sources.schemas import NEWS_ARTICLES, PAGES
from articleflow.sources.tables import read
from articleflow.streaming import stale, streams

NOW = "2026-01-01 00:00:00"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, d):
    """The event table as a stream; watermarks need an instant, so ``at`` is the time in UTC."""
    return streams.read(spark, d, "events", EVENTS).withColumn(
        "at", F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    )


@query("stream_dedupe", "SELECT event_type, user_id, 1::BIGINT AS n FROM events GROUP BY event_type, user_id")
def stream_dedupe(spark, d):
    """First event per kind and user; the delay covers the log, so state is whole."""
    kept = streams.dedupe(_events(spark, d), ["event_type", "user_id"], "at", "3650 days")
    path = streams.append_to(kept.select("event_type", "user_id", "event_id"), fresh_path(spark, "dedupe"))
    return spark.read.parquet(path).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_windows",
    "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def stream_windows(spark, d):
    counts = streams.window_stats(_events(spark, d), "at", "event_type", "1 hour")
    return streams.all_windows(counts, fresh_path(spark, "windows"), "event_type").select(
        F.unix_timestamp("window_start").alias("window_start"), "event_type", "n"
    )


@query(
    "stream_sliding",
    """WITH x AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS s, event_type FROM events, (VALUES (0), (1), (2)) o(k))
    SELECT epoch(s)::BIGINT AS window_start, event_type, count(*) AS n FROM x GROUP BY ALL""",
)
def stream_sliding(spark, d):
    counts = streams.window_stats(_events(spark, d), "at", "event_type", "3 hours", "1 hour")
    return streams.all_windows(counts, fresh_path(spark, "sliding"), "event_type").select(
        F.unix_timestamp("window_start").alias("window_start"), "event_type", "n"
    )


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER p >= INTERVAL 2 HOUR OR lag(ts) OVER p IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
    b AS (SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, epoch(date_trunc('second', a))::BIGINT AS session_start, epoch(date_trunc('second', z)) + 7200 AS session_end, n FROM b""",
)
def stream_sessions(spark, d):
    counts = streams.session_stats(_events(spark, d), "at", "user_id", "2 hours")
    found = streams.all_sessions(counts, fresh_path(spark, "sessions"), "user_id")
    return found.select("user_id", *(F.unix_timestamp(c).alias(c) for c in ("session_start", "session_end")), "n")


def _task_stream(spark, d, timed=False):
    kind = F.col("event_type")
    event = (
        F.when(kind.isin("click", "view"), "claim").when(kind == "purchase", "complete")
        .when((kind == "error") & (F.col("value") > 150), "delete").when(kind == "error", "fail").otherwise("request")
    )
    return _events(spark, d).select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), event.alias("event"), *(["at"] if timed else [])
    )


@query("stream_tasks", FOLD_SQL)
def stream_tasks(spark, d):
    return plain_states(streams.task_states(_task_stream(spark, d), fresh_path(spark, "tasks")))


#: A task is late once ten minutes have passed in processing; the watermark is ten minutes behind the last event.
_LATE = "(a.s = 'processing' AND x.us > a.us + 600000000)"
_MOVES = "((a.s = 'pending' AND x.s = 'claim') OR (a.s = 'processing' AND x.s IN ('complete', 'fail', 'delete')) OR (a.s = 'failed' AND x.s = 'request'))"
_MOVED = f"(CASE WHEN {_LATE} THEN x.s = 'request' ELSE {_MOVES} END)"


@query(
    "stream_task_timers",
    f"""WITH ev AS (SELECT user_id AS task_id, event_id AS seq, epoch_us(ts) AS us, CASE WHEN event_type IN ('click', 'view') THEN 'claim'
      WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'error' AND value > 150 THEN 'delete' WHEN event_type = 'error' THEN 'fail' ELSE 'request' END AS event FROM events),
    lim AS (SELECT (max(us) // 1000 - 600000) * 1000 AS w FROM ev),
    walked AS (SELECT task_id, list_reduce(l, lambda a, x: {{
      's': CASE WHEN {_LATE} THEN CASE WHEN x.s = 'request' THEN 'pending' ELSE 'failed' END WHEN NOT {_MOVES} THEN a.s
        WHEN x.s = 'claim' THEN 'processing' WHEN x.s = 'complete' THEN 'completed' WHEN x.s = 'fail' THEN 'failed' WHEN x.s = 'delete' THEN 'deleted' ELSE 'pending' END,
      'applied': a.applied + {_MOVED}::BIGINT, 'ignored': a.ignored + (NOT {_MOVED})::BIGINT, 'stale': a.stale + {_LATE}::BIGINT,
      'updated': CASE WHEN {_MOVED} THEN x.updated ELSE a.updated END, 'us': CASE WHEN {_MOVED} THEN x.us ELSE a.us END}},
      {{'s': 'pending', 'applied': 0::BIGINT, 'ignored': 0::BIGINT, 'stale': 0::BIGINT, 'updated': -1::BIGINT, 'us': 0::BIGINT}}) AS f
      FROM (SELECT task_id, list({{'s': event, 'applied': 0::BIGINT, 'ignored': 0::BIGINT, 'stale': 0::BIGINT, 'updated': seq, 'us': us}} ORDER BY us, seq) AS l FROM ev GROUP BY task_id)),
    last AS (SELECT *, f.s = 'processing' AND f.us + 600000000 < w AS late FROM walked, lim)
    SELECT task_id, CASE WHEN late THEN 'failed' ELSE f.s END AS status, f.applied AS applied, f.ignored AS ignored, f.stale + late::BIGINT AS stale, f.updated AS updated_seq FROM last""",
)
def stream_task_timers(spark, d):
    """The task log in event time with a deadline of ten minutes, also for tasks without a further event."""
    events = _task_stream(spark, d, True)
    found = stale.task_states_with_timer(events, fresh_path(spark, "task-timers"))
    return found.withColumn("updated_seq", F.coalesce("updated_seq", F.lit(-1)))


def _interaction_stream(spark, d):
    kind = F.col("event_type")
    return streams.read(spark, d, "events", EVENTS).select(
        F.col("user_id").cast("string").alias("client_id"),
        F.get_json_object("props", "$.k").cast("long").alias("news_id"),
        F.when(kind.isin("click", "signup"), "add").when(kind == "view", "remove").alias("action"),
        F.when(kind == "purchase", F.lit(True)).when(kind == "error", F.lit(False)).alias("helpful"),
        F.col("event_id").alias("seq"),
        "ts",
    )


@query(
    "stream_favorites",
    f"WITH {INTERACTIONS_SQL} SELECT client_id, news_id, id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM fav",
)
def stream_favorites(spark, d):
    found = streams.favorite_states(_interaction_stream(spark, d), fresh_path(spark, "favorites"))
    return found.withColumn("created_at", stamp(F.col("created_at")))


@query(
    "stream_feedback",
    f"""WITH {INTERACTIONS_SQL} SELECT client_id, news_id, helpful, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
    strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM fb""",
)
def stream_feedback(spark, d):
    found = streams.feedback_states(_interaction_stream(spark, d), fresh_path(spark, "feedback"))
    return found.withColumns({c: stamp(F.col(c)) for c in ("created_at", "updated_at")})


@query(
    "stream_ingest",
    f"""WITH {PARAGRAPH_SQL}, {TITLE_SQL}, bodies AS (SELECT page_id, string_agg(text, chr(10) ORDER BY p_idx) AS content FROM paragraphs GROUP BY page_id),
    cut AS (SELECT page_id, t, CASE WHEN ends_with(t, '.') THEN t[:-2] WHEN ends_with(t, ' that') THEN t[:-6] ELSE t END AS title FROM titles),
    good AS (SELECT page_id, title, sha256(content) AS content_hash FROM cut JOIN bodies USING (page_id) WHERE length(regexp_replace(content, '\\P{{L}}', '', 'g')) >= 400
      AND t <> 'of' AND title <> '')
    SELECT min(page_id) AS seq, arg_min(title, page_id) AS title, content_hash FROM good WHERE content_hash NOT IN (SELECT sha256(text) FROM benchmark) GROUP BY content_hash""",
)
def stream_ingest(spark, d):
    stored = ingest.with_hash(read(spark, d, "benchmark").select(F.col("text").alias("content")))
    pages = streams.read(spark, d, "pages", PAGES).withColumn("category", F.lit("国内"))
    found = streams.ingest(pages, SITE, as_of(NOW), fresh_path(spark, "ingest"), ["国内"], stored)
    return found.select("seq", "title", "content_hash")


ROUND_SQL = """WITH raw AS (SELECT doc_id, source, text, sha256(text) AS h, CASE WHEN doc_id % 97 = 0 OR lang = 'es' OR trim(split_part(text, chr(10), 1)) = '' THEN 'rejected' END AS r FROM documents),
  firsts AS (SELECT h, min(doc_id) AS f FROM raw WHERE r IS NULL GROUP BY h)
  SELECT 'crawl' AS phase, source AS name, count(*) AS fetched, count(*) FILTER (r IS NULL AND f = doc_id) AS created FROM raw LEFT JOIN firsts USING (h) GROUP BY source
  UNION ALL SELECT 'tables', 'articles', (SELECT count(*) FROM firsts) + (SELECT count(*) FROM benchmark), (SELECT count(*) FROM firsts)"""


@query("worker_round", ROUND_SQL)
def worker_round(spark, d):
    """Recover, ingest and count over all documents; the summary phase has a test of its own."""
    known = read(spark, d, "benchmark")
    have = {
        "id": F.col("item_id"), "content": F.col("text"), "title": F.lit("stored"), "summary_status": F.lit("processing"),
        "content_hash": sha256(F.concat(F.lit("stored:"), F.col("text"))), "updated_at": F.lit("2025-12-31 00:00:00"),
    }
    table = known.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NEWS_ARTICLES.fields])
    empty = read(spark, d, "events").where("false")
    favorites = empty.select(F.col("user_id").cast("string").alias("client_id"), F.col("event_id").alias("news_id"))
    done = run_round(table, favorites, favorites, [document_articles(spark, d)], as_of(NOW), skip_summary=True)
    crawl = done.crawl_stats.select(F.lit("crawl").alias("phase"), F.col("source").alias("name"), "fetched", "created")
    rows = done.articles.agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("summary_status") == "pending").alias("created"))
    return crawl.unionByName(rows.select(F.lit("tables").alias("phase"), F.lit("articles").alias("name"), "fetched", "created"))


def _plain_model():
    """A stand-in model whose summaries state no facts."""
    return lambda texts: ["fertig" for _ in texts]


@query(
    "worker_round_summaries",
    r"""WITH """ + INTERACTIONS_SQL + r""", art AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'completed' WHEN doc_id % 10 = 1 THEN 'failed'
      WHEN doc_id % 10 = 2 THEN 'processing' WHEN ceil(n_chars / 4.0) > 512 THEN 'deleted'
      WHEN len(list_filter(regexp_extract_all(replace(text, chr(10), ''), '[^.!?]*[.!?][.!?”’」』）)\]"'']*|[^.!?]+$'),
        lambda s: length(regexp_replace(s, '\P{L}', '', 'g')) >= 2)) = 0 THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN doc_id % 10 > 2 THEN 1 ELSE 0 END AS claimed FROM documents),
    gone AS (SELECT id FROM art WHERE status = 'deleted')
    SELECT 'articles' AS name, status, count(*) AS n FROM art WHERE status <> 'deleted' GROUP BY status
    UNION ALL SELECT 'outcomes', status, count(*) FROM art WHERE claimed = 1 GROUP BY status
    UNION ALL SELECT 'favorites', 'left', count(*) FROM fav WHERE news_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'feedback', 'left', count(*) FROM fb WHERE news_id NOT IN (SELECT id FROM gone)""",
)
def worker_round_summaries(spark, d):
    """The whole round: stale tasks fail, every pending article is summarised, and what is too long goes with its dependents."""
    docs = read(spark, d, "documents")
    status = F.when(F.col("doc_id") % 10 == 0, "completed").when(F.col("doc_id") % 10 < 3, "processing").otherwise("pending")
    have = {
        "id": F.col("doc_id"), "content": F.col("text"), "title": F.lit("t"), "summary_status": status, "content_hash": sha256(F.col("text")),
        # one of the two in processing was touched too long ago
        "updated_at": F.when(F.col("doc_id") % 10 == 1, "2025-12-31 00:00:00").otherwise(NOW),
    }
    articles = docs.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NEWS_ARTICLES.fields])
    log = interactions(spark, d)
    done = run_round(
        articles, users.fold_favorites(log), users.fold_feedback(log), [], as_of(NOW), batch_limit=None, make_predict=_plain_model,
        token_count=F.ceil(F.length("content") / 4), char_per_token=2.0, enders=ENDERS, script="letters", token_pattern=WORDS,
    )
    row = F.lit(1).alias("one")
    counts = done.summary_stats.select(F.explode(F.create_map(*(x for c in done.summary_stats.columns for x in (F.lit(c), F.col(c))))).alias("status", "n")).where("n > 0")
    left = lambda name, df: df.select(row).agg(F.count("one").alias("n")).select(F.lit(name).alias("name"), F.lit("left").alias("status"), "n")
    return (
        done.articles.groupBy(F.lit("articles").alias("name"), F.col("summary_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
        .unionByName(counts.select(F.lit("outcomes").alias("name"), "status", "n"))
        .unionByName(left("favorites", done.favorites)).unionByName(left("feedback", done.feedback))
    )
