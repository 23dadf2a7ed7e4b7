"""Explicit schemas; constraints the storage engine used to enforce are audit queries."""

from __future__ import annotations

from pyspark.sql import types as T

_T = T.TimestampNTZType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


RAW_ARTICLE = _struct(
    title=T.StringType(), content=T.StringType(), category=T.StringType(),
    source=T.StringType(), source_url=T.StringType(), publish_time=_T,
)
NEWS_ARTICLES = _struct(
    id=T.LongType(), title=T.StringType(), content=T.StringType(), summary=T.StringType(),
    category=T.StringType(), source=T.StringType(), source_url=T.StringType(),
    content_hash=T.StringType(), publish_time=_T, crawl_time=_T, summary_status=T.StringType(),
    summary_time_ms=T.IntegerType(), summary_error=T.StringType(),
    model_version=T.StringType(), created_at=_T, updated_at=_T,
)
FAVORITES = _struct(id=T.LongType(), client_id=T.StringType(), news_id=T.LongType(), created_at=_T)
FEEDBACK = _struct(
    id=T.LongType(), client_id=T.StringType(), news_id=T.LongType(),
    helpful=T.BooleanType(), created_at=_T, updated_at=_T,
)
MODEL_EVALUATIONS = _struct(
    id=T.LongType(), model_version=T.StringType(), model_name=T.StringType(),
    dataset=T.StringType(), dataset_split=T.StringType(), sample_count=T.IntegerType(),
    rouge1=T.DecimalType(7, 6), rouge2=T.DecimalType(7, 6), rougeL=T.DecimalType(7, 6),
    avg_generation_time_ms=T.IntegerType(), p95_generation_time_ms=T.IntegerType(), created_at=_T,
)
RUNS = _struct(
    run_id=T.StringType(), task=T.StringType(), status=T.StringType(),
    acceptance_status=T.StringType(), evaluation_profile=T.StringType(),
    formal_result=T.BooleanType(), model_name=T.StringType(), model_version=T.StringType(),
    evaluated_count=T.LongType(), sample_count=T.LongType(), failed_count=T.LongType(),
    rouge1=T.DoubleType(), rouge2=T.DoubleType(), corpus_rougeL=T.DoubleType(),
    quality_pass_rate=T.DoubleType(), latency_pass_rate=T.DoubleType(),
    avg_generation_time_ms=T.DoubleType(), p95_generation_time_ms=T.DoubleType(),
    contract_mismatch=T.BooleanType(), sampling_seed=T.StringType(),
    sampling_method=T.StringType(), full_test_count=T.LongType(), eligible_count=T.LongType(),
    excluded_count=T.LongType(),
)
PAGES = _struct(page_id=T.LongType(), url=T.StringType(), html=T.StringType())
TABLES = {
    "news_articles": NEWS_ARTICLES,
    "favorites": FAVORITES,
    "feedback": FEEDBACK,
    "model_evaluations": MODEL_EVALUATIONS,
    "pages": PAGES,
}
