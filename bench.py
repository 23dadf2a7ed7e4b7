"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from articleflow.plans import catalogue
from articleflow.session import build_session

HEADLINE = [
    "list_page", "favorites_list", "user_state", "favorite_fold", "feedback_fold", "task_fold",
    "ingest_outcomes", "ingest_first_copies", "validate_split", "constraint_audit", "links_category",
    "round_robin", "paragraphs", "titles", "build_articles", "sentences", "corpus_audit", "duplicates",
    "length_stats", "distribution_prices", "hash_sample", "quantile_sample", "rolling_mean",
    "rouge_overlap", "rouge_l", "latency_summary", "fact_check", "tfidf_vectors", "rank_embeddings",
    "rank_sentences", "budget_select", "extractive", "stream_windows", "stream_tasks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.load()
    catalogue.QUERIES["category_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
