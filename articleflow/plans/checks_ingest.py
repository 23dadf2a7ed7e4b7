"""Ingest and validation over the given tables."""

from pyspark.sql import functions as F

from articleflow.functions.text import sha256
from articleflow.operators import ingest, quality, users
from articleflow.plans.catalogue import query
from articleflow.plans.jobs import run_round
from articleflow.plans.mapping import DOCUMENTS_SQL, INTERACTIONS_SQL, as_of, document_articles, interactions
from articleflow.sources.schemas import NEWS_ARTICLES
from articleflow.sources.tables import read

NOW = "2026-01-01 00:00:00"


@query("validate_split", f"WITH {DOCUMENTS_SQL} SELECT seq, coalesce(reason, 'valid') AS reason FROM judged")
def validate_split(spark, d):
    valid, rejected = quality.split_articles(document_articles(spark, d))
    return valid.select("seq", F.lit("valid").alias("reason")).unionByName(rejected.select("seq", "reason"))


def _stored(spark, d):
    """Articles of earlier rounds: the conversations and every tenth document's text."""
    talk = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    docs = document_articles(spark, d).where("source = 'src3'").select(
        (F.col("seq") + 1_000_000).alias("id"), "content"
    )
    return ingest.with_hash(talk.unionByName(docs))


OUTCOME_SQL = DOCUMENTS_SQL + """,
stored AS (SELECT sha256(text) AS h FROM benchmark UNION SELECT sha256(text) FROM documents WHERE source = 'src3'),
firsts AS (SELECT content_hash, min(seq) AS f FROM judged WHERE reason IS NULL GROUP BY ALL),
outcome AS (SELECT seq, source, reason, judged.content_hash, CASE WHEN reason IS NOT NULL THEN 'rejected'
  WHEN f = seq AND judged.content_hash NOT IN (SELECT h FROM stored) THEN 'created' ELSE 'deduped' END AS outcome
  FROM judged LEFT JOIN firsts USING (content_hash))"""


@query("ingest_outcomes", f"WITH {OUTCOME_SQL} SELECT seq, outcome FROM outcome")
def ingest_outcomes(spark, d):
    rows = ingest.outcomes(document_articles(spark, d), _stored(spark, d), quality.CATEGORIES)
    return rows.select("seq", "outcome")


@query(
    "ingest_stats",
    f"""WITH {OUTCOME_SQL} SELECT source, count(*) AS fetched, count(*) FILTER (outcome = 'created') AS created,
    count(*) FILTER (outcome = 'deduped') AS deduped, count(*) FILTER (outcome = 'rejected') AS rejected
    FROM outcome GROUP BY source""",
)
def ingest_stats(spark, d):
    return ingest.stats(ingest.outcomes(document_articles(spark, d), _stored(spark, d), quality.CATEGORIES))


@query("ingest_first_copies", f"WITH {DOCUMENTS_SQL} SELECT min(seq) AS seq, arg_min(title, seq) AS title, content_hash FROM judged GROUP BY content_hash")
def ingest_first_copies(spark, d):
    rows = ingest.first_by_hash(ingest.with_hash(document_articles(spark, d)))
    return rows.select("seq", "title", "content_hash")


@query(
    "ingest_match",
    f"""WITH {OUTCOME_SQL} SELECT 'fresh' AS side, count(*) AS n, count(DISTINCT content_hash) AS contents FROM judged
    WHERE content_hash NOT IN (SELECT h FROM stored) UNION ALL
    SELECT 'stored', count(*), count(DISTINCT h) FROM (SELECT sha256(text) AS h FROM benchmark UNION ALL
      SELECT sha256(text) FROM documents WHERE source = 'src3') WHERE h IN (SELECT content_hash FROM judged)""",
)
def ingest_match(spark, d):
    fresh, known = ingest.match(ingest.with_hash(document_articles(spark, d)), _stored(spark, d))
    size = lambda df, side: df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("content_hash").alias("contents")
    ).select(F.lit(side).alias("side"), "n", "contents")
    return size(fresh, "fresh").unionByName(size(known, "stored"))


@query(
    "ingest_append",
    f"""WITH {OUTCOME_SQL}, stored_rows AS (SELECT item_id AS id, '' AS title, sha256(text) AS content_hash FROM benchmark)
    SELECT id, title, content_hash, 'completed' AS summary_status FROM stored_rows UNION ALL
    SELECT (SELECT max(id) FROM stored_rows) + row_number() OVER (ORDER BY j.seq), title, j.content_hash, 'pending'
    FROM judged j JOIN outcome o ON o.seq = j.seq WHERE outcome = 'created'""",
)
def ingest_append(spark, d):
    arrived = document_articles(spark, d)
    created = ingest.outcomes(arrived, _stored(spark, d), quality.CATEGORIES).where("outcome = 'created'")
    fresh = ingest.with_hash(arrived).join(created.select("seq"), "seq", "left_semi")
    known = read(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("content"),
        sha256(F.col("text")).alias("content_hash"), F.lit("completed").alias("summary_status"),
    )
    have = set(known.columns)
    table = known.select(
        *[
            F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in NEWS_ARTICLES.fields
        ]
    )
    return ingest.append(fresh, table, as_of(NOW)).select("id", "title", "content_hash", "summary_status")


@query(
    "sources_union",
    """SELECT source, count(*) AS n, sum(length(content))::BIGINT AS chars FROM (
    SELECT source, text AS content FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark
    UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY source""",
)
def sources_union(spark, d):
    parts = [document_articles(spark, d).select("source", "content")] + [
        read(spark, d, name).select(F.lit(name).alias("source"), F.col("text").alias("content"))
        for name in ("benchmark", "conversations")
    ]
    return ingest.union_sources(parts).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars")
    )


TWO_SQL = DOCUMENTS_SQL + """,
stored AS (SELECT sha256(text) AS h FROM benchmark),
arrived AS (SELECT CASE WHEN seq % 2 = 0 THEN 'A' ELSE 'B' END AS site, seq % 2 AS part, seq // 2 AS n, title, reason, content_hash FROM judged),
firsts AS (SELECT content_hash, min(row(part, n)) AS f FROM arrived WHERE reason IS NULL GROUP BY ALL),
outcome AS (SELECT a.*, CASE WHEN reason IS NOT NULL THEN 'rejected'
  WHEN f = row(part, n) AND a.content_hash NOT IN (SELECT h FROM stored) THEN 'created' ELSE 'deduped' END AS outcome
  FROM arrived a LEFT JOIN firsts USING (content_hash))"""


def _two_sources(spark, d):
    """Documents as two sites that both count their rows from zero, and the benchmark as stored articles."""
    rows = document_articles(spark, d)
    halves = [
        rows.where(F.col("seq") % 2 == n).withColumns({"source": F.lit(site), "seq": F.expr("seq div 2")})
        for n, site in enumerate("AB")
    ]
    known = read(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("content"),
        sha256(F.col("text")).alias("content_hash"), F.lit("completed").alias("summary_status"),
    )
    table = known.select(
        *(F.col(f.name) if f.name in known.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in NEWS_ARTICLES.fields)
    )
    none = known.where("false").select(F.col("title").alias("client_id"), F.col("id").alias("news_id"))
    return run_round(table, none, none, halves, as_of(NOW), skip_summary=True)


@query(
    "two_source_stats",
    f"""WITH {TWO_SQL} SELECT site AS source, count(*) AS fetched, count(*) FILTER (outcome = 'created') AS created,
    count(*) FILTER (outcome = 'deduped') AS deduped, count(*) FILTER (outcome = 'rejected') AS rejected
    FROM outcome GROUP BY site""",
)
def two_source_stats(spark, d):
    return _two_sources(spark, d).crawl_stats


@query(
    "two_source_articles",
    f"""WITH {TWO_SQL} SELECT item_id AS id, '' AS title, NULL AS source, sha256(text) AS content_hash FROM benchmark UNION ALL
    SELECT (SELECT max(item_id) FROM benchmark) + row_number() OVER (ORDER BY part, n), title, site, content_hash
    FROM outcome WHERE outcome = 'created'""",
)
def two_source_articles(spark, d):
    return _two_sources(spark, d).articles.select("id", "title", "source", "content_hash")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", sha256(F.col("text")).alias("content_hash"))


AUDIT_SQL = f"""WITH {DOCUMENTS_SQL}, {INTERACTIONS_SQL},
a AS (SELECT seq AS id, title, content, category, source, source_url, content_hash,
  CASE WHEN seq % 50 = 0 THEN 'stuck' ELSE 'pending' END AS summary_status FROM judged),
f AS (SELECT client_id, news_id + 100 AS news_id FROM inter WHERE action = 'add'),
b AS (SELECT client_id, news_id FROM inter WHERE helpful IS NOT NULL)
SELECT 'article_not_null' AS "check", count(*) FILTER (title IS NULL OR content IS NULL OR category IS NULL OR source IS NULL
  OR source_url IS NULL OR content_hash IS NULL) AS violations FROM a
UNION ALL SELECT 'article_status_domain', count(*) FILTER (summary_status NOT IN ('pending', 'processing', 'completed', 'failed')) FROM a
UNION ALL SELECT 'article_length_limits', count(*) FILTER (length(title) > 255 OR length(source_url) > 1024) FROM a
UNION ALL SELECT 'article_unique_content_hash', count(*) FROM (SELECT content_hash FROM a GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'article_unique_id', count(*) FROM (SELECT id FROM a GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'favorite_unique_client_news', count(*) FROM (SELECT client_id, news_id FROM f GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'feedback_unique_client_news', count(*) FROM (SELECT client_id, news_id FROM b GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'favorite_orphans', count(*) FROM f WHERE news_id NOT IN (SELECT id FROM a)
UNION ALL SELECT 'feedback_orphans', count(*) FROM b WHERE news_id NOT IN (SELECT id FROM a)"""


@query("constraint_audit", AUDIT_SQL)
def constraint_audit(spark, d):
    articles = ingest.with_hash(document_articles(spark, d)).withColumnRenamed("seq", "id").withColumn(
        "summary_status", F.when(F.col("id") % 50 == 0, "stuck").otherwise("pending")
    )
    log = interactions(spark, d)
    favorites = log.where("action = 'add'").select("client_id", (F.col("news_id") + 100).alias("news_id"))
    feedback = log.where("helpful is not null").select(*users.PAIR)
    return quality.audit(articles, favorites, feedback)
