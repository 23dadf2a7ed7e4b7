"""Evaluation of summaries and runs over the given tables."""

from pyspark.sql import functions as F

from articleflow.operators import evals, rouge
from articleflow.plans.catalogue import query
from articleflow.plans.mapping import as_of, rounded, stamp
from articleflow.session import fresh_path
from articleflow.sources import runs as run_registry
from articleflow.sources import sinks
from articleflow.sources.schemas import MODEL_EVALUATIONS
from articleflow.sources.tables import read, read_spread

NOW = "2026-01-01 00:00:00"


def _pairs(spark, d):
    """Each document scored against the benchmark passage its number falls on."""
    items = read(spark, d, "benchmark").select("item_id", F.col("text").alias("reference"))
    docs = read_spread(spark, d, "documents", "doc_id")
    number = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    return docs.withColumn("item_id", F.col("doc_id") % number).join(items, "item_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("prediction"), "reference"
    )


TOKEN_SQL = """
pairs AS (SELECT doc_id AS id, d.text AS prediction, b.text AS reference FROM documents d
  JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
tok AS (SELECT id, list_transform(regexp_extract_all(prediction, '[A-Za-z0-9]+|[^\\s]'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9]') THEN lower(t) ELSE t END) AS p,
  list_transform(regexp_extract_all(reference, '[A-Za-z0-9]+|[^\\s]'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9]') THEN lower(t) ELSE t END) AS r FROM pairs)"""
GRAM_SQL = TOKEN_SQL + """,
g AS (SELECT id, 1 AS n, unnest(p) AS gram, 1 AS c, 0 AS e FROM tok UNION ALL SELECT id, 1, unnest(r), 0, 1 FROM tok
  UNION ALL SELECT id, 2, unnest(list_transform(generate_series(1, len(p) - 1), lambda i: p[i] || ' ' || p[i + 1])), 1, 0 FROM tok
  UNION ALL SELECT id, 2, unnest(list_transform(generate_series(1, len(r) - 1), lambda i: r[i] || ' ' || r[i + 1])), 0, 1 FROM tok),
cnt AS (SELECT id, n, gram, sum(c) AS c, sum(e) AS e FROM g GROUP BY ALL),
ov AS (SELECT id, n, sum(least(c, e)) AS o, sum(c) AS c, sum(e) AS e FROM cnt GROUP BY ALL),
f AS (SELECT id, n, CASE WHEN o > 0 THEN 2 * (o / c) * (o / e) / (o / c + o / e) ELSE 0 END AS f, o, c, e FROM ov)"""


#: Row by row of the table of common subsequences; tokens that the reference lacks change no row.
LCS_SQL = """
lcs AS (SELECT id, len(p) AS c, len(r) AS e, list_reduce(list_transform(list_filter(p, lambda t: list_contains(r, t)), lambda t: {'t': t, 'row': CAST([] AS BIGINT[])}),
  lambda a, x: {'t': x.t, 'row': list_reduce(list_transform(range(1, len(r) + 1), lambda j: [j]),
    lambda b, j: list_append(b, greatest(b[-1], CASE WHEN r[j[1]] = x.t THEN a.row[j[1]] + 1 ELSE a.row[j[1] + 1] END)), CAST([0] AS BIGINT[]))},
  {'t': '', 'row': list_transform(range(0, len(r) + 1), lambda j: 0::BIGINT)}).row[-1] AS o FROM tok),
lf AS (SELECT id, CASE WHEN o > 0 THEN 2 * (o / c) * (o / e) / (o / c + o / e) ELSE 0 END AS l FROM lcs)"""


@query(
    "rouge_overlap",
    f"""WITH {GRAM_SQL} SELECT id, max(CASE WHEN n = 1 THEN o ELSE 0 END)::BIGINT AS overlap1, max(CASE WHEN n = 1 THEN c ELSE 0 END)::BIGINT AS predicted1,
    max(CASE WHEN n = 1 THEN e ELSE 0 END)::BIGINT AS expected1, max(CASE WHEN n = 2 THEN o ELSE 0 END)::BIGINT AS overlap2,
    max(CASE WHEN n = 2 THEN c ELSE 0 END)::BIGINT AS predicted2, max(CASE WHEN n = 2 THEN e ELSE 0 END)::BIGINT AS expected2 FROM f GROUP BY id""",
)
def rouge_overlap(spark, d):
    return rouge.overlap(_pairs(spark, d))


@query("rouge_1", f"WITH {GRAM_SQL} SELECT id, round(f, 6) AS rouge1 FROM f WHERE n = 1")
def rouge_1(spark, d):
    return rounded(rouge.n(_pairs(spark, d), 1), ["rouge1"])


@query("rouge_l", f'WITH {TOKEN_SQL}, {LCS_SQL} SELECT id, round(l, 6) AS "rougeL" FROM lf')
def rouge_l(spark, d):
    return rounded(rouge.l(_pairs(spark, d)), ["rougeL"])


def _predictions(spark, d):
    """Documents as predictions with failures: too long ones, and unlabelled Spanish ones."""
    docs = read(spark, d, "documents")
    outcome = F.when(F.col("n_chars") > 6000, "too_long").when(F.col("lang") == "es", "failed").otherwise("ok")
    error = F.when(outcome != "ok", F.concat(F.lit("E:"), outcome))
    return docs.select(
        F.col("doc_id").alias("id"), outcome.alias("outcome"), error.alias("error"),
        F.when(outcome == "ok", F.when(F.col("lang") == "de", F.lit(" ")).otherwise(F.col("text"))).alias("prediction"),
    )


@query(
    "eval_score",
    f"""WITH {GRAM_SQL}, {LCS_SQL}, s AS (SELECT doc_id AS id, CASE WHEN n_chars > 6000 THEN 'pipeline_contract_mismatch'
      WHEN lang IN ('es', 'de') THEN 'failed' ELSE 'evaluated' END AS status, CASE WHEN n_chars > 6000 THEN 'E:too_long' WHEN lang = 'es' THEN 'E:failed'
      WHEN lang = 'de' THEN 'RuntimeError: pipeline_returned_empty_summary' ELSE '' END AS error FROM documents)
    SELECT id, status, error, coalesce(round(max(f) FILTER (n = 1 AND status = 'evaluated'), 6), -1) AS rouge1,
    coalesce(round(max(f) FILTER (n = 2 AND status = 'evaluated'), 6), -1) AS rouge2,
    coalesce(round(max(l) FILTER (status = 'evaluated'), 6), -1) AS "rougeL" FROM s JOIN f USING (id) JOIN lf USING (id) GROUP BY ALL""",
)
def eval_score(spark, d):
    scored = rouge.score(_predictions(spark, d), _pairs(spark, d).select("id", "reference"))
    minus = lambda c: F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c)
    return scored.select("id", "status", F.coalesce("error", F.lit("")).alias("error"), minus("rouge1"), minus("rouge2"), minus("rougeL"))


def _scores(spark, d):
    """Events as scored samples of one model per kind."""
    v = F.col("value")
    return read(spark, d, "events").select(
        F.col("event_type").alias("model_version"),
        F.when(F.col("user_id") % 10 == 0, "failed").otherwise("evaluated").alias("status"),
        F.least(v / 100, F.lit(1.0)).alias("rouge1"), F.least(v / 200, F.lit(1.0)).alias("rouge2"),
        F.least(v / 150, F.lit(1.0)).alias("rougeL"),
    )


SCORES_SQL = """
sc AS (SELECT event_type AS model_version, CASE WHEN user_id % 10 = 0 THEN 'failed' ELSE 'evaluated' END AS status, least(value / 100, 1.0) AS rouge1,
  least(value / 200, 1.0) AS rouge2, least(value / 150, 1.0) AS rougeL, value * 10 AS ms FROM events),
agg AS (SELECT model_version, avg(rouge1) FILTER (status = 'evaluated') AS rouge1, avg(rouge2) FILTER (status = 'evaluated') AS rouge2,
  avg(rougeL) FILTER (status = 'evaluated') AS rougeL, count(*) FILTER (status = 'evaluated') AS evaluated_count,
  count(*) FILTER (status = 'evaluated' AND rougeL >= 0.4) AS quality_pass_count, count(*) FILTER (status <> 'evaluated') AS failed_count FROM sc GROUP BY 1),
lat AS (SELECT model_version, count(ms) AS sample_count, avg(ms) AS a, median(ms) AS med, quantile_cont(ms, 0.95) AS p95, min(ms) AS lo, max(ms) AS hi,
  count(*) FILTER (ms < 1500) AS passed FROM sc GROUP BY 1)"""


@query(
    "eval_aggregate",
    f"""WITH {SCORES_SQL} SELECT model_version, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rougeL, 6) AS rougeL,
    round(rougeL, 6) AS corpus_rougeL, evaluated_count FROM agg""",
)
def eval_aggregate(spark, d):
    found = evals.aggregate(_scores(spark, d), ["model_version"])
    return rounded(found, ["rouge1", "rouge2", "rougeL", "corpus_rougeL"])


@query(
    "eval_quality",
    f"WITH {SCORES_SQL} SELECT model_version, quality_pass_count, round(quality_pass_count / evaluated_count, 6) AS quality_pass_rate FROM agg",
)
def eval_quality(spark, d):
    return rounded(evals.quality(_scores(spark, d), by=["model_version"]), ["quality_pass_rate"])


def _latencies(spark, d):
    return read(spark, d, "events").select(
        F.col("event_type").alias("model_version"), (F.col("value") * 10).alias("generation_time_ms")
    )


LATENCY_COLS = [
    "avg_generation_time_ms", "min_generation_time_ms", "max_generation_time_ms",
    "latency_pass_rate", "median_generation_time_ms", "p95_generation_time_ms",
]
LATENCY_SQL = """sample_count, round(a, 6) AS avg_generation_time_ms, round(med, 6) AS median_generation_time_ms, round(p95, 6) AS p95_generation_time_ms,
  round(lo, 6) AS min_generation_time_ms, round(hi, 6) AS max_generation_time_ms, passed AS latency_pass_count, round(passed / sample_count, 6) AS latency_pass_rate,
  passed / sample_count >= 0.95 AND p95 < 1500 AS latency_target_met"""


@query("latency_summary", f"WITH {SCORES_SQL} SELECT model_version, {LATENCY_SQL} FROM lat")
def latency_summary(spark, d):
    found = evals.latency_met(evals.latency(_latencies(spark, d), ["model_version"]))
    return rounded(found, LATENCY_COLS)


@query(
    "latency_whole",
    f"""WITH {SCORES_SQL}, lat2 AS (SELECT count(ms) AS sample_count, avg(ms) AS a, median(ms) AS med, quantile_cont(ms, 0.95) AS p95, min(ms) AS lo,
    max(ms) AS hi, count(*) FILTER (ms < 1500) AS passed FROM sc) SELECT {LATENCY_SQL} FROM lat2""",
)
def latency_whole(spark, d):
    return rounded(evals.latency_met(evals.latency(_latencies(spark, d))), LATENCY_COLS)


@query(
    "accounting",
    """SELECT count(*) FILTER (NOT (n_chars > 6000 OR lang = 'es')) AS succeeded, count(*) FILTER (n_chars > 6000 OR lang = 'es') AS failed,
    count(*) FILTER (n_chars <= 6000 AND lang = 'de') AS empty_outputs,
    round(avg(CASE WHEN lang = 'de' THEN 1 ELSE length(text) END) FILTER (NOT (n_chars > 6000 OR lang = 'es')), 6) AS mean_length,
    round(median(CASE WHEN lang = 'de' THEN 1 ELSE length(text) END) FILTER (NOT (n_chars > 6000 OR lang = 'es')), 6) AS median_length,
    true AS covered FROM documents""",
)
def accounting(spark, d):
    results = _predictions(spark, d).withColumnRenamed("prediction", "summary")
    return rounded(evals.accounting(results, read(spark, d, "documents")), ["mean_length", "median_length"])


def _runs(spark, d):
    """One quality and one benchmark run per user: metrics of their events."""
    v = F.col("value")
    user = F.col("user_id").cast("string")
    base = read(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v > 400).alias("high"), F.max(v).alias("top"),
        F.avg(F.least(v / 100, F.lit(1.0))).alias("m"), F.count_if(v > 2).alias("fast"),
    )
    ok = F.col("top") > 200
    return base.select(
        F.concat(F.lit("q-"), F.lpad(user, 8, "0")).alias("run_id"),
        F.when(F.col("user_id") % 7 == 0, "other").otherwise("B2-10").alias("task"),
        F.lit("completed").alias("status"),
        F.when(ok, "passed").otherwise("failed").alias("acceptance_status"),
        F.lit("course_sampled").alias("evaluation_profile"),
        F.lit(True).alias("formal_result"),
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("model-"), user)).alias("model_name"),
        F.concat(F.lit("v"), user).alias("model_version"),
        F.col("n").alias("evaluated_count"), F.col("high").alias("failed_count"),
        F.round(F.col("m"), 6).alias("rouge1"), F.round(F.col("m") / 2, 6).alias("rouge2"),
        F.round(F.col("m") * 0.9, 6).alias("corpus_rougeL"),
        F.round(F.col("fast") / F.col("n"), 6).alias("quality_pass_rate"),
        F.lit("20260907").alias("sampling_seed"), F.lit("hash").alias("sampling_method"),
        F.col("n").alias("full_test_count"), F.col("fast").alias("eligible_count"),
        (F.col("n") - F.col("fast")).alias("excluded_count"), F.lit(False).alias("contract_mismatch"),
    )


def _benches(spark, d):
    stats = evals.latency(
        read(spark, d, "events").select(
            F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("model_version"), (F.col("value") * 10).alias("generation_time_ms")
        ),
        ["model_version"],
    )
    return stats.where("sample_count > 50").select(
        F.concat(F.lit("b-"), F.col("model_version")).alias("run_id"), F.lit("B2-14").alias("task"),
        F.lit(True).alias("formal_result"), F.lit("passed").alias("acceptance_status"), "model_version", "sample_count",
        F.round("avg_generation_time_ms", 3).alias("avg_generation_time_ms"),
        F.round("p95_generation_time_ms", 3).alias("p95_generation_time_ms"), "latency_pass_rate",
    )


RUNS_SQL = """
b0 AS (SELECT user_id, count(*) AS n, count(*) FILTER (value > 400) AS high, max(value) AS top, avg(least(value / 100, 1.0)) AS m, count(*) FILTER (value > 2) AS fast,
  avg(value * 10) AS lavg, quantile_cont(value * 10, 0.95) AS p95, count(*) FILTER (value * 10 < 1500) / count(*) AS lrate FROM events GROUP BY user_id),
q AS (SELECT user_id, 'q-' || lpad(user_id::VARCHAR, 8, '0') AS run_id, CASE WHEN user_id % 7 = 0 THEN 'other' ELSE 'B2-10' END AS task, top > 200 AS passed,
  CASE WHEN user_id % 11 <> 0 THEN 'model-' || user_id END AS model_name, 'v' || user_id AS model_version, n, high, fast, round(m, 6) AS rouge1,
  round(m / 2, 6) AS rouge2, round(m * 0.9, 6) AS rougeL, round(fast / n, 6) AS quality_pass_rate, lavg, p95, lrate FROM b0),
acc AS (SELECT * FROM q WHERE task = 'B2-10' AND passed)"""


@query(
    "runs_latest",
    f"WITH {RUNS_SQL} SELECT run_id, model_version, n AS evaluated_count FROM acc ORDER BY run_id DESC LIMIT 1",
)
def runs_latest(spark, d):
    """Through files: records are written as JSON and read back as a registry."""
    path = fresh_path(spark, "runs")
    sinks.jsonl(_runs(spark, d), path)
    found = run_registry.read(spark, path, multi_line=False)
    return run_registry.latest(found, run_registry.accepted_quality()).select("run_id", "model_version", "evaluated_count")


@query(
    "eval_gate",
    f"""WITH {RUNS_SQL} SELECT run_id, concat_ws(',', CASE WHEN rougeL < 0.4 THEN 'corpus_rougeL' END, CASE WHEN quality_pass_rate < 0.95 THEN 'quality_pass_rate' END,
    CASE WHEN lrate < 0.95 OR n <= 50 THEN 'latency_pass_rate' END, CASE WHEN round(p95, 3) >= 1500 OR n <= 50 THEN 'p95_generation_time_ms' END,
    CASE WHEN high > 0 THEN 'pipeline_generation_failures' END) AS reason FROM q""",
)
def eval_gate(spark, d):
    timing = _benches(spark, d).select("model_version", "latency_pass_rate", "p95_generation_time_ms")
    runs = _runs(spark, d).withColumnRenamed("corpus_rougeL", "rougeL").join(timing, "model_version", "left")
    accepted, rejected = evals.gate(runs)
    return accepted.select("run_id", F.lit("").alias("reason")).unionByName(rejected.select("run_id", "reason"))


DELIVER_SQL = f"""WITH {RUNS_SQL} SELECT model_name, model_version, 'CNewSum' AS dataset, 'test' AS dataset_split, n AS sample_count, rouge1, rouge2, rougeL,
    round(lavg, 3) AS avg_generation_time_ms, round(p95, 3) AS p95_generation_time_ms"""


@query("deliver", DELIVER_SQL + " FROM acc WHERE n > 50 AND model_name IS NOT NULL")
def deliver(spark, d):
    quality = _runs(spark, d).where(run_registry.accepted_quality())
    bench = _benches(spark, d).where(run_registry.accepted_benchmark())
    return evals.deliver(_lack(quality), bench)[0]


def _lack(runs):
    """Quality runs have no timing of their own."""
    none = F.lit(None).cast("double")
    return runs.withColumns(
        {"avg_generation_time_ms": none, "p95_generation_time_ms": none, "latency_pass_rate": none, "sample_count": none}
    )


@query(
    "deliver_rejected",
    f"""WITH {RUNS_SQL} SELECT run_id AS quality_run_id, model_version, CASE WHEN n <= 50 THEN 'model_version_mismatch' ELSE 'delivery_missing:model_name' END AS reason
    FROM acc WHERE n <= 50 OR model_name IS NULL""",
)
def deliver_rejected(spark, d):
    quality = _runs(spark, d).where(run_registry.accepted_quality())
    return evals.deliver(_lack(quality), _benches(spark, d))[1]


@query(
    "deliver_sampled",
    DELIVER_SQL + """, run_id AS quality_run_id, 'b-' || model_version AS performance_run_id, n AS performance_sample_size, '20260907' AS sampling_seed,
    'hash' AS sampling_method, n AS full_test_count, fast AS eligible_count, n - fast AS excluded_count, NOT (lrate >= 0.95 AND round(p95, 3) < 1500) AS optimisation_needed,
    false AS full_evaluation FROM q WHERE task = 'B2-10' AND n > 50 AND model_name IS NOT NULL""",
)
def deliver_sampled(spark, d):
    quality = _runs(spark, d).where(run_registry.sampled("B2-10"))
    return evals.deliver(_lack(quality), _benches(spark, d), "sampled")[0]


@query(
    "eval_compare",
    f"""WITH {SCORES_SQL}, o AS (SELECT * FROM agg WHERE model_version = 'view'), w AS (SELECT * FROM agg WHERE model_version = 'click')
    SELECT round(w.rouge1 - o.rouge1, 6) AS delta_rouge1, round(w.rouge2 - o.rouge2, 6) AS delta_rouge2, round(w.rougeL - o.rougeL, 6) AS delta_rougeL,
    round(w.quality_pass_count / w.evaluated_count - o.quality_pass_count / o.evaluated_count, 6) AS delta_quality_pass_rate,
    CASE WHEN w.rougeL > o.rougeL THEN 'new_model_preferred' ELSE 'old_model_preferred' END AS selection FROM o, w""",
)
def eval_compare(spark, d):
    def one(model):
        rows = _scores(spark, d).where(F.col("model_version") == model)
        rate = evals.quality(rows).select("quality_pass_rate").scalar()
        return evals.aggregate(rows).withColumn("quality_pass_rate", rate)

    cols = ["delta_rouge1", "delta_rouge2", "delta_rougeL", "delta_quality_pass_rate"]
    return rounded(evals.compare(one("view"), one("click")), cols)


RANK_SQL = f"""WITH {RUNS_SQL} SELECT model_version, round(0.7 * least(1, greatest(0, (rougeL - 0.4) / 0.6)) + 0.3 * least(1, greatest(0, (1500 - round(p95, 3)) / 1500)), 6)
    AS candidate_score, rougeL FROM q WHERE n > 50"""


@query("eval_rank", RANK_SQL)
def eval_rank(spark, d):
    timing = _benches(spark, d).select("model_version", "p95_generation_time_ms")
    runs = _runs(spark, d).withColumnRenamed("corpus_rougeL", "rougeL").join(timing, "model_version")
    ranked = evals.rank(runs)
    return rounded(ranked.select("model_version", "candidate_score", "rougeL"), ["candidate_score"])


def _evaluations(spark, d):
    """Stored evaluations, one per user: created when the user was last seen."""
    rows = read(spark, d, "events").groupBy("user_id").agg(
        F.max("ts").alias("created_at"), F.avg(F.least(F.col("value") / 100, F.lit(1.0))).alias("m")
    )
    m = F.round(F.col("m"), 4).cast("decimal(7,6)")
    have = {
        "id": F.col("user_id"), "model_version": F.concat(F.lit("v"), F.col("user_id").cast("string")),
        "rouge1": m, "rouge2": m, "rougeL": m, "created_at": F.col("created_at"),
    }
    return rows.select(
        *[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MODEL_EVALUATIONS.fields]
    )


EVAL_SQL = """ev AS (SELECT user_id AS id, 'v' || user_id AS model_version, round(avg(least(value / 100, 1.0)), 4) AS rougeL, max(ts) AS created_at FROM events GROUP BY user_id)"""


@query(
    "latest_eval",
    f"""WITH {EVAL_SQL} SELECT id, model_version, rougeL, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM ev
    ORDER BY ev.created_at DESC, id DESC LIMIT 1""",
)
def latest_eval(spark, d):
    top = evals.latest(_evaluations(spark, d))
    return top.select("id", "model_version", "rougeL", stamp(F.col("created_at")).alias("created_at"))


@query(
    "evals_append",
    f"""WITH {EVAL_SQL}, {RUNS_SQL} SELECT id, model_version, rougeL FROM ev UNION ALL
    SELECT user_id + 100000, model_version, rougeL FROM q WHERE n > 50 AND high = 0 AND rougeL >= 0.4
      AND quality_pass_rate >= 0.95 AND lrate >= 0.95 AND round(p95, 3) < 1500""",
)
def evals_append(spark, d):
    """Runs that pass the gate join the stored evaluations."""
    timing = _benches(spark, d).select(
        "model_version", "latency_pass_rate", "avg_generation_time_ms", "p95_generation_time_ms"
    )
    runs = _runs(spark, d).withColumnsRenamed({"corpus_rougeL": "rougeL", "evaluated_count": "sample_count"})
    accepted, _ = evals.gate(runs.join(timing, "model_version", "left"))
    numbered = accepted.withColumn("id", F.substring("run_id", 3, 8).cast("long") + 100000)
    table = evals.append(numbered, _evaluations(spark, d), as_of(NOW))
    return table.select("id", "model_version", F.col("rougeL").cast("double").alias("rougeL"))


@query(
    "runs_refused",
    f"""WITH {RUNS_SQL} SELECT 'evaluated_count' AS field, (SELECT count(*) FROM q WHERE n % 2 = 1) AS refused
    UNION ALL SELECT 'formal_result', (SELECT count(*) FROM q WHERE task = 'other')
    UNION ALL SELECT 'kept', (SELECT count(*) FROM q)""",
)
def runs_refused(spark, d):
    """Odd values through files: half counts and a flag as text are refused, their records stay."""
    path = fresh_path(spark, "odd-runs")
    odd = _runs(spark, d).select(
        "run_id", "task", (F.col("evaluated_count") / 2).alias("halves"),
        F.when(F.col("task") == "other", F.lit("yes")).alias("formal_result"),
    )
    count = F.when(F.col("halves") % 1 == 0, F.format_string("%d", F.col("halves").cast("long"))).otherwise(F.col("halves").cast("string"))
    fields = F.concat(F.lit('{"evaluated_count":'), count, F.lit(","), F.expr("substring(to_json(struct(run_id, task, formal_result)), 2)"))
    odd.select(fields.alias("value")).write.text(path)
    counts = run_registry.refused(spark, path, multi_line=False).where("refused > 0")
    kept = run_registry.read(spark, path, multi_line=False).agg(F.count(F.lit(1)).alias("refused"))
    return counts.unionByName(kept.select(F.lit("kept").alias("field"), "refused"))
