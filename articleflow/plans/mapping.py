"""How the given tables stand in for articles, interactions, tasks and runs, in Spark and in SQL.

The SQL fragments are common table expressions for the query catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.sources.tables import read, read_spread

TIME = "yyyy-MM-dd HH:mm:ss"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def as_of(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def stamp(col: Column) -> Column:
    return F.date_format(col, TIME)


def orders_articles(spark: SparkSession, d: str) -> DataFrame:
    """Orders as an article table: dates, categories and task states."""
    key = F.col("o_orderkey")
    done = F.col("o_orderstatus") == "F"
    return read(spark, d, "orders").select(
        key.alias("id"),
        F.concat(F.lit("Order "), key).alias("title"),
        F.concat(F.lit("Body of order "), key, F.lit(" by "), F.col("o_custkey")).alias("content"),
        F.when(done, F.concat(F.lit("Summary of "), key)).alias("summary"),
        F.col("o_orderpriority").alias("category"),
        F.lit("orders").alias("source"),
        F.concat(F.lit("https://orders.example.com/"), key).alias("source_url"),
        F.when(key % 10 != 0, F.col("o_orderdate")).alias("publish_time"),
        F.when(done, "completed")
        .when(F.col("o_orderstatus") == "O", "pending")
        .when(key % 2 == 0, "processing")
        .otherwise("failed")
        .alias("summary_status"),
        F.when(done, (key % 1000).cast("int")).alias("summary_time_ms"),
        F.when((F.col("o_orderstatus") == "P") & (key % 2 == 1), "timeout").alias("summary_error"),
        F.when(done, "v1").alias("model_version"),
        F.col("o_orderdate").alias("updated_at"),
    )


ORDERS_SQL = """
art AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title,
  'Body of order ' || o_orderkey || ' by ' || o_custkey AS content,
  CASE WHEN o_orderstatus = 'F' THEN 'Summary of ' || o_orderkey END AS summary,
  o_orderpriority AS category, 'orders' AS source, 'https://orders.example.com/' || o_orderkey AS source_url,
  CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS publish_time,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending'
       WHEN o_orderkey % 2 = 0 THEN 'processing' ELSE 'failed' END AS summary_status,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 1000 END AS summary_time_ms,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 1 THEN 'timeout' END AS summary_error,
  CASE WHEN o_orderstatus = 'F' THEN 'v1' END AS model_version, o_orderdate AS updated_at FROM orders)"""

LANG_CATEGORY = {"en": "科技", "fr": "财经", "de": "社会"}


def document_articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as raw articles; Spanish ones get a category outside the domain."""
    category = F.lit("娱乐")
    for lang, name in LANG_CATEGORY.items():
        category = F.when(F.col("lang") == lang, name).otherwise(category)
    return read(spark, d, "documents").select(
        F.col("doc_id").alias("seq"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        category.alias("category"),
        "source",
        F.when(F.col("doc_id") % 97 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit("https://docs.example.com/"), F.col("doc_id")))
        .alias("source_url"),
        F.lit(None).cast("timestamp_ntz").alias("publish_time"),
    )


DOCUMENTS_SQL = """
raw AS (SELECT doc_id AS seq, split_part(text, chr(10), 1) AS title, text AS content,
  CASE lang WHEN 'en' THEN '科技' WHEN 'fr' THEN '财经' WHEN 'de' THEN '社会' ELSE '娱乐' END AS category,
  source, CASE WHEN doc_id % 97 = 0 THEN '  ' ELSE 'https://docs.example.com/' || doc_id END AS source_url
  FROM documents),
judged AS (SELECT *, CASE WHEN category NOT IN ('科技', '财经', '社会', '体育', '国内', '国际') THEN 'invalid_category'
  WHEN trim(title) = '' OR regexp_full_match(content, '\\s*') THEN 'blank_title_or_content'
  WHEN trim(source_url) = '' THEN 'blank_source_url' END AS reason, sha256(content) AS content_hash FROM raw)"""


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """Events as user interactions with articles: props.k is the article."""
    kind = F.col("event_type")
    return read(spark, d, "events").select(
        F.col("user_id").cast("string").alias("client_id"),
        F.get_json_object("props", "$.k").cast("long").alias("news_id"),
        F.when(kind.isin("click", "signup"), "add").when(kind == "view", "remove").alias("action"),
        F.when(kind == "purchase", F.lit(True)).when(kind == "error", F.lit(False)).alias("helpful"),
        F.col("event_id").alias("seq"),
        "ts",
    )


INTERACTIONS_SQL = """
inter AS (SELECT user_id::VARCHAR AS client_id, json_extract(props, '$.k')::BIGINT AS news_id,
  CASE WHEN event_type IN ('click', 'signup') THEN 'add' WHEN event_type = 'view' THEN 'remove' END AS action,
  CASE WHEN event_type = 'purchase' THEN true WHEN event_type = 'error' THEN false END AS helpful,
  event_id AS seq, ts FROM events),
lastrem AS (SELECT client_id, news_id, max(seq) AS r FROM inter WHERE action = 'remove' GROUP BY ALL),
fav AS (SELECT i.client_id, i.news_id, min(i.seq) AS id, min(i.ts) AS created_at FROM inter i
  LEFT JOIN lastrem l ON l.client_id = i.client_id AND l.news_id = i.news_id
  WHERE i.action = 'add' AND (l.r IS NULL OR i.seq > l.r) GROUP BY ALL),
fb AS (SELECT client_id, news_id, arg_max(helpful, seq) AS helpful, arg_min(ts, seq) AS created_at,
  arg_max(ts, seq) AS updated_at FROM inter WHERE helpful IS NOT NULL GROUP BY ALL)"""


def task_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a task log: every user is a task."""
    kind = F.col("event_type")
    event = (
        F.when(kind.isin("click", "view"), "claim")
        .when(kind == "purchase", "complete")
        .when((kind == "error") & (F.col("value") > 150), "delete")
        .when(kind == "error", "fail")
        .otherwise("request")
    )
    return read(spark, d, "events").select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), event.alias("event"), "ts"
    )


TASKS_SQL = """
tev AS (SELECT user_id AS task_id, event_id AS seq, ts, CASE WHEN event_type IN ('click', 'view') THEN 'claim'
  WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'error' AND value > 150 THEN 'delete'
  WHEN event_type = 'error' THEN 'fail' ELSE 'request' END AS event FROM events),
lists AS (SELECT task_id, list({'event': event, 'seq': seq, 's': 'pending', 'applied': 0::BIGINT, 'ignored': 0::BIGINT,
    'result': NULL::BIGINT, 'error': NULL::BIGINT, 'updated': NULL::BIGINT} ORDER BY seq) AS l FROM tev GROUP BY task_id),
folded AS (SELECT task_id, list_reduce(l, lambda a, x: {
  'event': x.event, 'seq': x.seq,
  's': CASE WHEN a.s = 'pending' AND x.event = 'claim' THEN 'processing'
            WHEN a.s = 'processing' AND x.event = 'complete' THEN 'completed'
            WHEN a.s = 'processing' AND x.event = 'fail' THEN 'failed'
            WHEN a.s = 'processing' AND x.event = 'delete' THEN 'deleted'
            WHEN a.s = 'failed' AND x.event = 'request' THEN 'pending' ELSE a.s END,
  'applied': a.applied + CASE WHEN (a.s = 'pending' AND x.event = 'claim') OR (a.s = 'failed' AND x.event = 'request')
     OR (a.s = 'processing' AND x.event IN ('complete', 'fail', 'delete')) THEN 1 ELSE 0 END,
  'ignored': a.ignored + CASE WHEN (a.s = 'pending' AND x.event = 'claim') OR (a.s = 'failed' AND x.event = 'request')
     OR (a.s = 'processing' AND x.event IN ('complete', 'fail', 'delete')) THEN 0 ELSE 1 END,
  'result': CASE WHEN a.s = 'processing' AND x.event = 'complete' THEN x.seq ELSE a.result END,
  'error': CASE WHEN a.s = 'processing' AND x.event = 'fail' THEN x.seq
                WHEN (a.s = 'processing' AND x.event = 'complete') OR (a.s = 'failed' AND x.event = 'request') THEN NULL
                ELSE a.error END,
  'updated': CASE WHEN (a.s = 'pending' AND x.event = 'claim') OR (a.s = 'failed' AND x.event = 'request')
     OR (a.s = 'processing' AND x.event IN ('complete', 'fail', 'delete')) THEN x.seq ELSE a.updated END},
  {'event': '', 'seq': -1::BIGINT, 's': 'pending', 'applied': 0::BIGINT, 'ignored': 0::BIGINT,
   'result': NULL::BIGINT, 'error': NULL::BIGINT, 'updated': NULL::BIGINT}) AS f FROM lists)"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a corpus with splits, sentence lists and first-line summaries."""
    return read_spread(spark, d, "documents", "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("article"),
        F.split("text", "\n").alias("sentences"),
        F.substring_index("text", "\n", 1).alias("summary"),
        F.when(F.length("source") == 4, "train").otherwise("test").alias("split"),
        F.ceil(F.length("text") / 4).alias("token_count"),
    )


CORPUS_SQL = """
corpus AS (SELECT doc_id AS id, text AS article, string_split(text, chr(10)) AS sentences,
  split_part(text, chr(10), 1) AS summary, CASE WHEN length(source) = 4 THEN 'train' ELSE 'test' END AS split,
  ceil(length(text) / 4.0)::BIGINT AS token_count FROM documents)"""


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})
