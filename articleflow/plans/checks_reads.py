"""Read queries and user state over the given tables."""

from pyspark.sql import functions as F

from articleflow.operators import quality, reads, tasks, users
from articleflow.operators.ordering import position
from articleflow.plans.catalogue import query
from articleflow.plans.mapping import (
    INTERACTIONS_SQL,
    ORDERS_SQL,
    PRIORITIES,
    interactions,
    orders_articles,
    stamp,
)
from articleflow.sources.tables import read

PAGE_SQL = """WITH {orders} SELECT id, title, summary, category, source,
  strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time, summary_status,
  (SELECT count(*) FROM art WHERE {where}) AS total, (SELECT count(*) FROM art WHERE {where}) > {seen} AS has_more
  FROM art WHERE {where} ORDER BY art.publish_time DESC NULLS LAST, id DESC LIMIT {size} OFFSET {skip}"""


@query("list_page", PAGE_SQL.format(orders=ORDERS_SQL, where="category = '1-URGENT'", seen=20, size=20, skip=0))
def list_page(spark, d):
    page = reads.page(orders_articles(spark, d), 1, 20, "1-URGENT", PRIORITIES)
    return page.withColumn("publish_time", stamp(F.col("publish_time")))


@query("list_page_deep", PAGE_SQL.format(orders=ORDERS_SQL, where="true", seen=300, size=50, skip=250))
def list_page_deep(spark, d):
    page = reads.page(orders_articles(spark, d), 6, 50, None, PRIORITIES)
    return page.withColumn("publish_time", stamp(F.col("publish_time")))


@query("point_lookup", f"WITH {ORDERS_SQL} SELECT id, title, content, category FROM art WHERE id = 17")
def point_lookup(spark, d):
    return reads.by_id(orders_articles(spark, d), 17).select("id", "title", "content", "category")


@query(
    "category_counts",
    f"WITH {ORDERS_SQL} SELECT category, summary_status, count(*) AS n FROM art GROUP BY ALL",
)
def category_counts(spark, d):
    return reads.counts(orders_articles(spark, d), ["category", "summary_status"])


@query(
    "status_view",
    f"WITH {ORDERS_SQL} SELECT id AS news_id, summary_status, summary, summary_time_ms AS generation_time_ms FROM art",
)
def status_view(spark, d):
    view = tasks.status_view(orders_articles(spark, d))
    return view.withColumn("generation_time_ms", F.col("generation_time_ms").cast("long"))


@query(
    "fixed_categories",
    """SELECT ord, category, count(doc_id) AS n FROM (VALUES (0::BIGINT, '科技'), (1, '财经'), (2, '社会'), (3, '体育'),
    (4, '国内'), (5, '国际')) c(ord, category) LEFT JOIN documents ON CASE lang WHEN 'en' THEN '科技' WHEN 'fr' THEN '财经'
    WHEN 'de' THEN '社会' ELSE '娱乐' END = category GROUP BY ALL""",
)
def fixed_categories(spark, d):
    from articleflow.plans.mapping import document_articles

    found = reads.counts(document_articles(spark, d), ["category"])
    return quality.categories(spark).join(found, "category", "left").select(
        F.col("ord").cast("long").alias("ord"), "category", F.coalesce("n", F.lit(0)).alias("n")
    )


@query(
    "favorite_fold",
    f"WITH {INTERACTIONS_SQL} SELECT client_id, news_id, id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM fav",
)
def favorite_fold(spark, d):
    folded = users.fold_favorites(interactions(spark, d))
    return folded.withColumn("created_at", stamp(F.col("created_at")))


@query(
    "feedback_fold",
    f"""WITH {INTERACTIONS_SQL} SELECT client_id, news_id, helpful, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
    strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM fb""",
)
def feedback_fold(spark, d):
    folded = users.fold_feedback(interactions(spark, d))
    return folded.withColumns({c: stamp(F.col(c)) for c in ("created_at", "updated_at")})


@query(
    "favorites_list",
    f"""WITH {INTERACTIONS_SQL}, {ORDERS_SQL} SELECT client_id, news_id, fav.id AS favorite_id,
    strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, title, category, summary_status
    FROM fav JOIN art ON art.id = fav.news_id""",
)
def favorites_list(spark, d):
    listed = users.favorites(users.fold_favorites(interactions(spark, d)), orders_articles(spark, d))
    return listed.select(
        "client_id", "news_id", "favorite_id", stamp(F.col("created_at")).alias("created_at"),
        "title", "category", "summary_status",
    )


@query(
    "favorites_of_client",
    f"""WITH {INTERACTIONS_SQL}, {ORDERS_SQL} SELECT news_id, fav.id AS favorite_id, title,
    row_number() OVER (ORDER BY created_at DESC, fav.id DESC) AS place
    FROM fav JOIN art ON art.id = fav.news_id WHERE client_id = '8'""",
)
def favorites_of_client(spark, d):
    listed = users.favorites(users.fold_favorites(interactions(spark, d)), orders_articles(spark, d), "8")
    rows = listed.select("news_id", "favorite_id", "title", "created_at", F.lit(0).alias("list"))
    order = [F.col("created_at").desc(), F.col("favorite_id").desc()]
    placed = position(rows, ["list"], order, -F.unix_date(F.to_date("created_at")), "place")
    return placed.select("news_id", "favorite_id", "title", F.col("place").cast("long"))


@query(
    "user_state",
    f"""WITH {INTERACTIONS_SQL}, pairs AS (SELECT DISTINCT client_id, news_id FROM inter)
    SELECT client_id, news_id, fav.id IS NOT NULL AS is_favorite, fb.helpful AS feedback FROM pairs
    LEFT JOIN fav USING (client_id, news_id) LEFT JOIN fb USING (client_id, news_id)""",
)
def user_state(spark, d):
    log = interactions(spark, d)
    pairs = log.select("client_id", "news_id").distinct()
    return users.state(pairs, users.fold_favorites(log), users.fold_feedback(log))


@query(
    "article_detail",
    f"""WITH {INTERACTIONS_SQL}, {ORDERS_SQL} SELECT art.id, title, content, summary, category, source, source_url,
    strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time, summary_status, summary_time_ms,
    f.id IS NOT NULL AS is_favorite, b.helpful AS feedback FROM art
    LEFT JOIN (SELECT * FROM fav WHERE client_id = '8') f ON f.news_id = art.id
    LEFT JOIN (SELECT * FROM fb WHERE client_id = '8') b ON b.news_id = art.id""",
)
def article_detail(spark, d):
    log = interactions(spark, d)
    full = reads.detail(
        orders_articles(spark, d), users.fold_favorites(log), users.fold_feedback(log), None, "8"
    )
    return full.withColumns(
        {
            "publish_time": stamp(F.col("publish_time")),
            "summary_time_ms": F.col("summary_time_ms").cast("long"),
        }
    )


@query(
    "known_split",
    f"""WITH {INTERACTIONS_SQL} SELECT seq, news_id, doc_id IS NOT NULL AS known FROM inter
    LEFT JOIN labels ON labels.doc_id = inter.news_id""",
)
def known_split(spark, d):
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("id"))
    known, unknown = users.split_known(interactions(spark, d), labels)
    pick = lambda df, flag: df.select("seq", "news_id", F.lit(flag).alias("known"))
    return pick(known, True).unionByName(pick(unknown, False))


CLIENT_SQL = """WITH h AS (SELECT event_id, event_type, md5(user_id::VARCHAR) AS m FROM events),
u AS (SELECT event_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || CASE WHEN event_type = 'view' THEN '1' ELSE '4' END ||
  substr(m, 14, 3) || '-' || CASE WHEN event_type = 'error' THEN '7' ELSE 'a' END || substr(m, 18, 3) || '-' || substr(m, 21, 12)
  || CASE WHEN event_type = 'signup' THEN '0' ELSE '' END AS client_id FROM h)
SELECT event_id, client_id, CASE WHEN length(client_id) <> 36 THEN 'bad_length' WHEN NOT regexp_matches(client_id,
  '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') THEN 'not_uuid4' ELSE 'ok' END AS reason FROM u"""


@query("client_ids", CLIENT_SQL)
def client_ids(spark, d):
    m = F.md5(F.col("user_id").cast("string"))
    part = lambda a, n: F.substring(m, a, n)
    kind = F.col("event_type")
    raw = F.concat(
        F.lit("  "), F.upper(F.concat(
            part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), F.when(kind == "view", "1").otherwise("4"),
            part(14, 3), F.lit("-"), F.when(kind == "error", "7").otherwise("a"), part(18, 3),
            F.lit("-"), part(21, 12), F.when(kind == "signup", "0").otherwise(""),
        )), F.lit("\t"),
    )
    ids = read(spark, d, "events").select("event_id", raw.alias("client_id"))
    good, bad = quality.split_client_ids(ids)
    return good.withColumn("reason", F.lit("ok")).unionByName(bad)


@query(
    "latest_interaction",
    """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
    arg_max(value, event_id) AS value FROM events GROUP BY user_id""",
)
def latest_interaction(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return users.latest(rows, ["user_id"], F.col("event_id"))
