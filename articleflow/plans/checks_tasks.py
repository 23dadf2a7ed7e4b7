"""Task states over the given tables."""

from pyspark.sql import functions as F

from articleflow.operators import tasks, users
from articleflow.plans.catalogue import query
from articleflow.plans.mapping import (
    INTERACTIONS_SQL,
    ORDERS_SQL,
    TASKS_SQL,
    as_of,
    interactions,
    orders_articles,
    stamp,
    task_events,
)
from articleflow.sources.tables import read

NOW = "1998-06-10 12:00:00"
FOLD_SQL = f"""WITH {TASKS_SQL} SELECT task_id, f.s AS status, f.applied AS applied, f.ignored AS ignored,
    coalesce(f.result, -1) AS result_seq, coalesce(f.error, -1) AS error_seq, coalesce(f.updated, -1) AS updated_seq FROM folded"""


def plain_states(states):
    return states.withColumns(
        {c: F.coalesce(F.col(c), F.lit(-1)) for c in ("result_seq", "error_seq", "updated_seq")}
    )


@query("task_fold", FOLD_SQL)
def task_fold(spark, d):
    return plain_states(tasks.fold(task_events(spark, d)))


@query("task_fold_narrow", FOLD_SQL)
def task_fold_narrow(spark, d):
    """The same fold cut into small chunks, as a hot task is at scale."""
    return plain_states(tasks.fold(task_events(spark, d), width=64))


WARNINGS_SQL = f"""WITH {TASKS_SQL}, walked AS (SELECT task_id, list_reduce(l, lambda a, x: {{
  's': CASE WHEN a.s = 'pending' AND x.rows[1].event = 'claim' THEN 'processing'
            WHEN a.s = 'processing' AND x.rows[1].event = 'complete' THEN 'completed'
            WHEN a.s = 'processing' AND x.rows[1].event = 'fail' THEN 'failed'
            WHEN a.s = 'processing' AND x.rows[1].event = 'delete' THEN 'deleted'
            WHEN a.s = 'failed' AND x.rows[1].event = 'request' THEN 'pending' ELSE a.s END,
  'rows': list_append(a.rows, {{'seq': x.rows[1].seq, 'event': x.rows[1].event, 'state': a.s}})}},
  {{'s': 'pending', 'rows': [{{'seq': -1::BIGINT, 'event': '', 'state': ''}}]}}) AS f
  FROM (SELECT task_id, list({{'s': '', 'rows': [{{'seq': seq, 'event': event, 'state': ''}}]}} ORDER BY seq) AS l FROM tev GROUP BY task_id)),
flat AS (SELECT task_id, unnest(f.rows) AS r FROM walked)
SELECT task_id, r.seq AS seq, r.event AS event, r.state AS state FROM flat WHERE r.seq >= 0 AND NOT (
  (r.state = 'pending' AND r.event = 'claim') OR (r.state = 'failed' AND r.event = 'request')
  OR (r.state = 'processing' AND r.event IN ('complete', 'fail', 'delete')))"""


@query("task_warnings", WARNINGS_SQL)
def task_warnings(spark, d):
    return tasks.ignored(task_events(spark, d))


PAIR_TASKS_SQL = TASKS_SQL.replace("user_id AS task_id", "user_id * 1000 + json_extract(props, '$.k')::BIGINT AS task_id")


@query(
    "task_stale_events",
    f"""WITH {PAIR_TASKS_SQL}, last AS (SELECT task_id, f.updated AS seq FROM folded WHERE f.s = 'processing')
    SELECT last.task_id, last.seq AS stale_seq, 'fail' AS event FROM last JOIN tev ON tev.task_id = last.task_id AND tev.seq = last.seq
    WHERE tev.ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE""",
)
def task_stale_events(spark, d):
    """Tasks are (user, article) pairs here, so that many of them are still running."""
    article = read(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("k")
    )
    log = task_events(spark, d).join(article, "seq").withColumn("task_id", F.col("task_id") * 1000 + F.col("k"))
    found = tasks.stale_events(tasks.fold(log), log, as_of("2024-01-20 00:00:00"))
    return found.select("task_id", "stale_seq", "event")


def _view(df):
    return df.select(
        "id", "summary_status", F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("summary_error", F.lit("")).alias("summary_error"),
        F.coalesce(F.col("summary_time_ms").cast("long"), F.lit(-1)).alias("summary_time_ms"),
        stamp(F.col("updated_at")).alias("updated_at"),
    )


VIEW_SQL = """SELECT id, summary_status, coalesce(summary, '') AS summary, coalesce(summary_error, '') AS summary_error,
  coalesce(summary_time_ms, -1) AS summary_time_ms, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM nxt"""


@query(
    "task_claim",
    f"""WITH {ORDERS_SQL}, c AS (SELECT id FROM art WHERE summary_status = 'pending' ORDER BY id LIMIT 50),
    nxt AS (SELECT art.* REPLACE (CASE WHEN c.id IS NOT NULL THEN 'processing' ELSE summary_status END AS summary_status,
      CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at) FROM art LEFT JOIN c USING (id)) {VIEW_SQL}""",
)
def task_claim(spark, d):
    return _view(tasks.claim(orders_articles(spark, d), as_of(NOW)))


@query(
    "task_claim_ids",
    f"""WITH {ORDERS_SQL}, nxt AS (SELECT * REPLACE (CASE WHEN id IN (2, 7, 9, 400) AND summary_status = 'pending' THEN 'processing'
      ELSE summary_status END AS summary_status, CASE WHEN id IN (2, 7, 9, 400) AND summary_status = 'pending' THEN TIMESTAMP '{NOW}'
      ELSE updated_at END AS updated_at) FROM art) {VIEW_SQL}""",
)
def task_claim_ids(spark, d):
    return _view(tasks.claim(orders_articles(spark, d), as_of(NOW), ids=[2, 7, 9, 400]))


RESULTS_SQL = """res AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'ok' WHEN '2-HIGH' THEN 'failed' ELSE 'too_long' END
  AS outcome, 'S' || o_custkey AS s, repeat('e', (o_custkey % 700)::INTEGER) AS e, o_custkey AS t FROM orders WHERE o_totalprice > 50000)"""


def _results(spark, d):
    level = F.col("o_orderpriority")
    return read(spark, d, "orders").where("o_totalprice > 50000").select(
        F.col("o_orderkey").alias("id"),
        F.when(level == "1-URGENT", "ok").when(level == "2-HIGH", "failed").otherwise("too_long").alias("outcome"),
        F.concat(F.lit("S"), F.col("o_custkey")).alias("summary"),
        F.expr("repeat('e', cast(o_custkey % 700 as int))").alias("error"),
        F.col("o_custkey").alias("generation_time_ms"),
        F.lit("v2").alias("model_version"),
    )


@query(
    "task_results",
    f"""WITH {ORDERS_SQL}, {RESULTS_SQL}, j AS (SELECT art.*, summary_status = 'processing' AND coalesce(outcome, '') = 'ok' AS done,
      summary_status = 'processing' AND coalesce(outcome, '') = 'failed' AS broke, s, e, t FROM art LEFT JOIN res USING (id)),
    nxt AS (SELECT * REPLACE (CASE WHEN done THEN 'completed' WHEN broke THEN 'failed' ELSE summary_status END AS summary_status,
      CASE WHEN done THEN s ELSE summary END AS summary, CASE WHEN done THEN t ELSE summary_time_ms END AS summary_time_ms,
      CASE WHEN broke THEN substr(e, 1, 500) WHEN done THEN NULL ELSE summary_error END AS summary_error,
      CASE WHEN done OR broke THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at) FROM j) {VIEW_SQL}""",
)
def task_results(spark, d):
    return _view(tasks.apply(orders_articles(spark, d), _results(spark, d), as_of(NOW)))


@query(
    "task_outcome_counts",
    f"""WITH {RESULTS_SQL} SELECT count(*) FILTER (outcome = 'ok') AS completed, count(*) FILTER (outcome = 'failed') AS failed,
    count(*) FILTER (outcome = 'too_long') AS deleted FROM res""",
)
def task_outcome_counts(spark, d):
    return tasks.stats(_results(spark, d))


@query(
    "task_request",
    f"""WITH {ORDERS_SQL}, asked AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45)
    SELECT id AS news_id, CASE WHEN summary_status = 'failed' THEN 'pending' ELSE summary_status END AS summary_status,
    coalesce(summary, '') AS summary FROM art SEMI JOIN asked USING (id)""",
)
def task_request(spark, d):
    asked = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    _, answer = tasks.request(orders_articles(spark, d), asked, as_of(NOW))
    return answer.select("news_id", "summary_status", F.coalesce("summary", F.lit("")).alias("summary"))


@query(
    "task_request_snapshot",
    f"""WITH {ORDERS_SQL}, asked AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45),
    hit AS (SELECT art.id FROM art JOIN asked USING (id) WHERE summary_status = 'failed'),
    nxt AS (SELECT art.* REPLACE (CASE WHEN hit.id IS NOT NULL THEN 'pending' ELSE summary_status END AS summary_status,
      CASE WHEN hit.id IS NULL THEN summary_error END AS summary_error,
      CASE WHEN hit.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at) FROM art LEFT JOIN hit USING (id)) {VIEW_SQL}""",
)
def task_request_snapshot(spark, d):
    asked = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    renewed, _ = tasks.request(orders_articles(spark, d), asked, as_of(NOW))
    return _view(renewed)


@query(
    "delete_unprocessable",
    f"""WITH {ORDERS_SQL}, {INTERACTIONS_SQL}, asked AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_totalprice > 100000),
    dep AS (SELECT news_id FROM fav UNION ALL SELECT news_id FROM fb)
    SELECT asked.id AS news_id, CASE WHEN summary_status = 'processing' THEN (SELECT count(*) FROM dep WHERE dep.news_id = asked.id)
    ELSE -1 END AS removed FROM asked JOIN art ON art.id = asked.id""",
)
def delete_unprocessable(spark, d):
    log = interactions(spark, d)
    asked = read(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("id"))
    *_, report = tasks.delete_unprocessable(
        orders_articles(spark, d), users.fold_favorites(log), users.fold_feedback(log), asked
    )
    return report


@query(
    "cascade_left",
    f"""WITH {INTERACTIONS_SQL}, gone AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 0)
    SELECT 'favorites' AS name, client_id, news_id FROM fav WHERE news_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'feedback', client_id, news_id FROM fb WHERE news_id NOT IN (SELECT id FROM gone)""",
)
def cascade_left(spark, d):
    log = interactions(spark, d)
    gone = read(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id")).distinct()
    fav, fb, _ = tasks.cascade(users.fold_favorites(log), users.fold_feedback(log), gone)
    pick = lambda df, name: df.select(F.lit(name).alias("name"), "client_id", "news_id")
    return pick(fav, "favorites").unionByName(pick(fb, "feedback"))


@query(
    "stale_recovery",
    f"""WITH {ORDERS_SQL}, nxt AS (SELECT * REPLACE (
      CASE WHEN late THEN 'failed' ELSE summary_status END AS summary_status,
      CASE WHEN late THEN 'Worker 异常中断恢复：processing 滞留超过 10 分钟' ELSE summary_error END AS summary_error,
      CASE WHEN late THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at)
      FROM (SELECT *, summary_status = 'processing' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AS late FROM art)) {VIEW_SQL}""",
)
def stale_recovery(spark, d):
    return _view(tasks.recover_stale(orders_articles(spark, d), as_of(NOW), 10))


@query(
    "zombie_reset",
    f"""WITH {ORDERS_SQL}, asked AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45),
    nxt AS (SELECT art.* REPLACE (CASE WHEN asked.id IS NOT NULL AND summary_status = 'processing' AND
      (updated_at IS NULL OR updated_at < TIMESTAMP '{NOW}' - INTERVAL 60 SECOND) THEN 'pending' ELSE summary_status END AS summary_status)
      FROM art LEFT JOIN asked USING (id)) {VIEW_SQL}""",
)
def zombie_reset(spark, d):
    asked = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return _view(tasks.reset_zombie(orders_articles(spark, d), asked, as_of(NOW)))
