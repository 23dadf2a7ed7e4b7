"""Evaluation of summary runs: averages, pass rates, latency, gates, comparison, delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions.text import is_blank
from articleflow.operators.stats import quantiles

# Fixed values.
QUALITY_THRESHOLD = 0.40
LATENCY_THRESHOLD_MS = 1500.0
PASS_RATE = 0.95
DATASET = "CNewSum"
DATASET_SPLIT = "test"
DELIVERY_FIELDS = [
    "model_name", "model_version", "dataset", "dataset_split", "sample_count",
    "rouge1", "rouge2", "rougeL", "avg_generation_time_ms", "p95_generation_time_ms",
]


def aggregate(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro averages over evaluated samples; null when there are none."""
    good = F.col("status") == "evaluated"
    mean = lambda c: F.avg(F.when(good, F.col(c)))
    return scores.groupBy(*by).agg(
        mean("rouge1").alias("rouge1"),
        mean("rouge2").alias("rouge2"),
        mean("rougeL").alias("rougeL"),
        mean("rougeL").alias("corpus_rougeL"),
        F.count_if(good).alias("evaluated_count"),
    )


def quality(scores: DataFrame, threshold: float = QUALITY_THRESHOLD, by: Sequence[str] = ()) -> DataFrame:
    """Samples at or above the threshold, and their share (null when there are none)."""
    good = F.col("status") == "evaluated"
    passed = F.count_if(good & (F.col("rougeL") >= threshold))
    return scores.groupBy(*by).agg(
        passed.alias("quality_pass_count"),
        F.try_divide(passed, F.count_if(good)).alias("quality_pass_rate"),
    )


def latency(
    df: DataFrame, by: Sequence[str] = (), col: str = "generation_time_ms", limit: float = LATENCY_THRESHOLD_MS
) -> DataFrame:
    """Latency summary; a pass is strictly below the limit."""
    by = list(by)
    passed = F.count_if(F.col(col) < limit)
    base = df.groupBy(*by).agg(
        F.count(col).alias("sample_count"),
        F.avg(col).alias("avg_generation_time_ms"),
        F.min(col).alias("min_generation_time_ms"),
        F.max(col).alias("max_generation_time_ms"),
        passed.alias("latency_pass_count"),
        F.try_divide(passed, F.count(col)).alias("latency_pass_rate"),
    )
    found = quantiles(df, col, [0.5, 0.95], by)
    pick = lambda r: F.max(F.when(F.col("ratio") == r, F.col("quantile")))
    middle = found.groupBy(*by).agg(
        pick(0.5).alias("median_generation_time_ms"), pick(0.95).alias("p95_generation_time_ms")
    )
    if by:
        return base.join(middle, by, "left")
    names = ["median_generation_time_ms", "p95_generation_time_ms"]
    return base.withColumns({n: middle.select(n).scalar() for n in names})


def latency_met(df: DataFrame, limit: float = LATENCY_THRESHOLD_MS) -> DataFrame:
    """Add ``latency_target_met``: share and p95 both good enough."""
    met = (F.col("latency_pass_rate") >= PASS_RATE) & (F.col("p95_generation_time_ms") < limit)
    return df.withColumn("latency_target_met", F.coalesce(met, F.lit(False)))


def accounting(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Successes and failures must cover the input; empty outputs and output lengths."""
    ok = F.col("outcome") == "ok"
    size = F.when(ok, F.length("summary"))
    total = expected.agg(F.count(F.lit(1)).alias("n")).scalar()
    median = quantiles(results.select(size.alias("_size")), "_size", [0.5]).select("quantile").scalar()
    counted = results.agg(
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & is_blank(F.col("summary"))).alias("empty_outputs"),
        F.avg(size).alias("mean_length"),
    )
    return counted.select(
        "*", median.alias("median_length"), (F.col("succeeded") + F.col("failed") == total).alias("covered")
    )


def gate_reasons() -> Column:
    """Names of the failed hard gates of a run, in a fixed order."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    checks = [
        (bad(F.col("rougeL") >= QUALITY_THRESHOLD), "corpus_rougeL"),
        (bad(F.col("quality_pass_rate") >= PASS_RATE), "quality_pass_rate"),
        (bad(F.col("latency_pass_rate") >= PASS_RATE), "latency_pass_rate"),
        (bad(F.col("p95_generation_time_ms") < LATENCY_THRESHOLD_MS), "p95_generation_time_ms"),
        (F.coalesce(F.col("failed_count") > 0, F.lit(False)), "pipeline_generation_failures"),
        (F.coalesce(F.col("contract_mismatch"), F.lit(False)), "pipeline_contract_mismatch"),
    ]
    return F.concat_ws(",", *[F.when(is_bad, name) for is_bad, name in checks])


def gate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted runs, rejected runs with ``reason``)."""
    judged = df.withColumn("reason", gate_reasons())
    return judged.where("reason = ''").drop("reason"), judged.where("reason <> ''")


def append(accepted: DataFrame, existing: DataFrame, as_of: Column) -> DataFrame:
    """The evaluation table plus accepted runs; history is kept, repeats are allowed."""
    rows = accepted.select(
        *[c for c in DELIVERY_FIELDS if c not in ("dataset", "dataset_split")],
        F.lit(DATASET).alias("dataset"),
        F.lit(DATASET_SPLIT).alias("dataset_split"),
        "id",
        as_of.alias("created_at"),
    )
    typed = rows.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in existing.schema.fields]
    )
    return existing.unionByName(typed)


def latest(df: DataFrame) -> DataFrame:
    """The newest evaluation as doubles, or no row."""
    top = df.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)
    return top.withColumns({c: F.col(c).cast("double") for c in ("rouge1", "rouge2", "rougeL")})


def deliver(quality_runs: DataFrame, benchmark_runs: DataFrame, profile: str = "full") -> tuple[DataFrame, DataFrame]:
    """(delivery rows, rejected quality runs with reason), joined on the model version.

    The sampled profile adds provenance columns and whether more optimisation is needed.
    """
    timing = ["avg_generation_time_ms", "p95_generation_time_ms"]
    bench = benchmark_runs.select(
        "model_version",
        F.lit(True).alias("_benchmarked"),
        *timing,
        F.col("run_id").alias("performance_run_id"),
        F.col("sample_count").alias("performance_sample_size"),
        "latency_pass_rate",
    )
    joined = quality_runs.drop(*timing, "latency_pass_rate", "sample_count").join(bench, "model_version", "left")
    payload = joined.select(
        F.col("run_id").alias("quality_run_id"),
        "model_name",
        "model_version",
        F.lit(DATASET).alias("dataset"),
        F.lit(DATASET_SPLIT).alias("dataset_split"),
        F.col("evaluated_count").alias("sample_count"),
        "rouge1",
        "rouge2",
        F.col("corpus_rougeL").alias("rougeL"),
        *timing,
        "_benchmarked",
        "performance_run_id",
        "performance_sample_size",
        "latency_pass_rate",
        *(
            ["sampling_seed", "sampling_method", "full_test_count", "eligible_count", "excluded_count"]
            if profile == "sampled"
            else []
        ),
    )
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in DELIVERY_FIELDS])
    reason = F.when(F.col("_benchmarked").isNull(), "model_version_mismatch").when(
        missing != "", F.concat(F.lit("delivery_missing:"), missing)
    )
    judged = payload.withColumn("reason", reason)
    good = judged.where("reason is null")
    if profile == "sampled":
        good = latency_met(good).withColumn("optimisation_needed", ~F.col("latency_target_met")).withColumn(
            "full_evaluation", F.lit(False)
        )
        extra = [
            "quality_run_id", "performance_run_id", "performance_sample_size", "sampling_seed",
            "sampling_method", "full_test_count", "eligible_count", "excluded_count",
            "optimisation_needed", "full_evaluation",
        ]
        good = good.select(*DELIVERY_FIELDS, *extra)
    else:
        good = good.select(*DELIVERY_FIELDS)
    return good, judged.where("reason is not null").select("quality_run_id", "model_version", "reason")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas of two one-row aggregates; the new model wins only with a strictly greater ROUGE-L."""
    metrics = ["rouge1", "rouge2", "rougeL", "quality_pass_rate"]
    cells = [F.col(m) - old.select(m).scalar() for m in metrics]
    return new.select(
        *[c.alias(f"delta_{m}") for c, m in zip(cells, metrics)],
        F.when(cells[2] > 0, "new_model_preferred").otherwise("old_model_preferred").alias("selection"),
    )


def rank(df: DataFrame) -> DataFrame:
    """Accepted candidates, best first: 0.7 quality + 0.3 speed, ties by ROUGE-L, then p95."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    value = 0.7 * clamp((F.col("rougeL") - 0.4) / 0.6) + 0.3 * clamp(
        (LATENCY_THRESHOLD_MS - F.col("p95_generation_time_ms")) / LATENCY_THRESHOLD_MS
    )
    return df.withColumn("candidate_score", value).orderBy(
        F.col("candidate_score").desc(), F.col("rougeL").desc(), F.col("p95_generation_time_ms").asc()
    )
