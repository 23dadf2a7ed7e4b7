"""Links, page extraction and page-level filters over the given tables."""

from pyspark.sql import functions as F

from articleflow.functions import html as H
from articleflow.functions.text import clean_web_text, count_cjk, sha256
from articleflow.operators import extract, links
from articleflow.plans.catalogue import query
from articleflow.plans.mapping import as_of, stamp
from articleflow.sources import pages as page_source
from articleflow.sources.tables import read

HOSTS = links.LinkRule(
    pattern=r'href="(/[^"]*)"',
    relative=True,
    key="host",
    date=r"/(\d{4})-(\d{2})/(\d{2})/",
    newest_first=False,
    category_of=(("blog", "社会"), ("www", "国内"), ("m", "科技")),
)

LINKS_SQL = """
occ AS (SELECT page_id, url, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS l FROM pages)),
cat AS (SELECT page_id, pos, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || link AS link,
  CASE regexp_extract(url, '^[a-zA-Z]+://([^./?#:]+)', 1) WHEN 'blog' THEN '社会' WHEN 'www' THEN '国内' WHEN 'm' THEN '科技' END
  AS category FROM occ),
uniq AS (SELECT category, link, min(page_id) AS page_id, arg_min(pos, page_id * 100000 + pos) AS pos
  FROM cat WHERE category IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY page_id, pos) AS rank,
  min(page_id * 100000 + pos) OVER (PARTITION BY category) AS ord FROM uniq)"""


def _host_links(spark, d):
    found = links.discover(page_source.read(spark, d), HOSTS)
    return links.dedupe(links.categorise(found, HOSTS).drop("key"))


@query("links_category", f"WITH {LINKS_SQL} SELECT category, link, page_id, pos FROM uniq")
def links_category(spark, d):
    return _host_links(spark, d)


@query(
    "links_ranked",
    f"WITH {LINKS_SQL} SELECT category, link, rank FROM ranked",
)
def links_ranked(spark, d):
    return links.ranked(_host_links(spark, d)).select("category", "link", "rank")


@query(
    "round_robin",
    f"""WITH {LINKS_SQL}, turns AS (SELECT *, row_number() OVER (ORDER BY rank, ord) AS turn FROM ranked WHERE length(link) % 3 > 0)
    SELECT turn, category, link, rank FROM turns WHERE turn <= 60""",
)
def round_robin(spark, d):
    rows = _host_links(spark, d).withColumn("ok", F.length("link") % 3 > 0)
    taken = links.round_robin(rows, 60).coalesce(1)
    return taken.select(
        (F.monotonically_increasing_id() + 1).alias("turn"), "category", "link", "rank"
    )


def _dated_links(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM/dd")
    key = F.col("o_orderkey")
    path = F.when(key % 40 == 0, F.concat(F.date_format("o_orderdate", "yyyy-"), F.lit("13/45"))).otherwise(day)
    return read(spark, d, "orders").select(
        F.floor(key / 50).cast("long").alias("page_id"),
        (key % 50).cast("long").alias("pos"),
        F.concat(F.lit("https://news.example.com/"), path, F.lit("/content_"), (key % 1000).cast("string"), F.lit(".htm")).alias("link"),
        F.col("o_orderpriority").alias("category"),
    )


DATED_SQL = """
dated AS (SELECT o_orderkey // 50 AS page_id, o_orderkey % 50 AS pos, 'https://news.example.com/' || CASE WHEN o_orderkey % 40 = 0
  THEN strftime(o_orderdate, '%Y-') || '13/45' ELSE strftime(o_orderdate, '%Y-%m/%d') END || '/content_' || (o_orderkey % 1000) || '.htm'
  AS link, o_orderpriority AS category, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate::DATE END AS link_date FROM orders),
recent AS (SELECT * FROM dated WHERE link_date::TIMESTAMP >= TIMESTAMP '1998-06-15 12:00:00' - INTERVAL 30 DAY),
uniq AS (SELECT category, link, min(link_date) AS link_date, min(page_id * 50 + pos) AS spot FROM recent GROUP BY ALL)"""
NOON = "1998-06-15 12:00:00"


@query(
    "links_newest_first",
    f"""WITH {DATED_SQL} SELECT category, link, row_number() OVER (PARTITION BY category ORDER BY link_date DESC, spot) AS rank FROM uniq""",
)
def links_newest_first(spark, d):
    recent = links.with_dates(_dated_links(spark, d), HOSTS, 30, as_of(NOON))
    return links.ranked(links.dedupe(recent), newest_first=True).select("category", "link", "rank")


@query(
    "links_today",
    f"WITH {DATED_SQL} SELECT category, count(DISTINCT link) AS found_today FROM uniq WHERE link_date = DATE '1998-06-15' GROUP BY category",
)
def links_today(spark, d):
    recent = links.with_dates(_dated_links(spark, d), HOSTS, 30, as_of(NOON))
    return links.today_counts(links.dedupe(recent), as_of(NOON))


PARAGRAPH_SQL = r"""
noise AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?is)<nav\b.*?</nav\s*>', '', 'g'),
  '(?is)<footer\b.*?</footer\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
inner_html AS (SELECT page_id, CASE WHEN regexp_matches(h, '(?is)<article[\s>]') THEN
  regexp_extract(h, '(?is)<article(?:\s[^>]*)?>(.*?)</article', 1) ELSE h END AS h FROM noise),
chunks AS (SELECT page_id, unnest(l[2:]) AS c, generate_subscripts(l[2:], 1) AS i FROM (
  SELECT page_id, regexp_split_to_array(h, '(?i)<p(?:\s[^>]*)?>') AS l FROM inner_html)),
texts AS (SELECT page_id, i, regexp_replace(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(c,
  '(?is)</p\s*>.*|</?(?:article|body|div|h[1-6]|html|li|table|ul|ol|section)(?:\s[^>]*)?>.*', ''), '(?s)<[^>]*>', ' ', 'g'),
  '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')), '^[·:]+|[·:]+$', '', 'g') AS text FROM chunks),
kept AS (SELECT page_id, text, min(i) AS i FROM texts WHERE length(text) >= 20 GROUP BY ALL),
paragraphs AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS p_idx, text FROM kept)"""


@query("paragraphs", f"WITH {PARAGRAPH_SQL} SELECT page_id, p_idx, text FROM paragraphs")
def paragraphs(spark, d):
    return extract.paragraphs(page_source.read(spark, d), ["article"])


@query(
    "paragraphs_assembled",
    f"WITH {PARAGRAPH_SQL} SELECT page_id, sha256(string_agg(text, chr(10) ORDER BY p_idx)) AS content_hash FROM paragraphs GROUP BY page_id",
)
def paragraphs_assembled(spark, d):
    rows = extract.dedupe_paragraphs(extract.paragraphs(page_source.read(spark, d), ["article"]))
    return extract.assemble(rows).select("page_id", sha256(F.col("content")).alias("content_hash"))


TITLE = r"""regexp_replace(trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<{t}(?:\s[^>]*)?>(.*?)</{t}\s*>', 1),
  '(?s)<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '&middot;', '·'), '\s+', ' ', 'g')), '^[·:]+|[·:]+$', '', 'g')"""
TITLE_SQL = f"""titles AS (SELECT page_id, {TITLE.format(t="h1")} AS h1, {TITLE.format(t="title")} AS t FROM pages)"""


@query("titles", f"WITH {TITLE_SQL} SELECT page_id, CASE WHEN h1 <> '' THEN h1 ELSE t END AS title, t AS title_tag FROM titles")
def titles(spark, d):
    html = F.col("html")
    return page_source.read(spark, d).select(
        "page_id", H.title(html).alias("title"), H.title_element(html).alias("title_tag")
    )


SITE = extract.SourceConfig(
    name="pages", containers=("article",), suffixes=(".", " that"), date_pattern=HOSTS.date,
    title_tag_first=True, seconds=False, meta_date=True, nav_titles=("of",), min_body=400, script="letters",
)

BUILD_SQL = f"""WITH {PARAGRAPH_SQL}, {TITLE_SQL}, bodies AS (SELECT page_id, string_agg(text, chr(10) ORDER BY p_idx) AS content
  FROM paragraphs GROUP BY page_id),
cut AS (SELECT page_id, t, CASE WHEN ends_with(t, '.') THEN t[:-2] WHEN ends_with(t, ' that') THEN t[:-6] ELSE t END AS title FROM titles)
SELECT page_id, CASE WHEN length(regexp_replace(coalesce(content, ''), '\\P{{L}}', '', 'g')) < 400 THEN 'short_body'
  WHEN t = 'of' THEN 'nav_page' WHEN title = '' THEN 'no_title' ELSE 'accepted' END AS reason, title,
  sha256(coalesce(content, '')) AS content_hash FROM cut LEFT JOIN bodies USING (page_id)"""


@query("build_articles", BUILD_SQL)
def build_articles(spark, d):
    seen = extract.examine(page_source.read(spark, d), SITE, as_of("2026-01-01 00:00:00"))
    return seen.select(
        "page_id", F.coalesce("reject_reason", F.lit("accepted")).alias("reason"), "title",
        sha256(F.col("content")).alias("content_hash"),
    )


TIMES_SQL = r"""SELECT event_id, strftime(CASE event_type WHEN 'view' THEN date_trunc('minute', ts) WHEN 'click' THEN date_trunc('minute', ts)
  WHEN 'purchase' THEN date_trunc('day', ts) WHEN 'error' THEN date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS publish_time FROM events"""


@query("page_times", TIMES_SQL)
def page_times(spark, d):
    cfg = extract.SOURCE_B
    kind, shown = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm")
    day = F.date_format("ts", "yyyy-MM-dd")
    html = (
        F.when(kind == "view", F.concat(F.lit("<span>2024-13-40 10:00</span> <b>"), shown, F.lit("</b>")))
        .when(kind == "click", F.concat(F.lit("at  "), F.regexp_replace(shown, " ", "\n "), F.lit(" GMT")))
        .when(kind == "purchase", F.concat(F.lit('<meta charset="x" name="publishdate" content="'), day, F.lit('">')))
        .otherwise(F.lit("no time"))
    )
    url = F.when(
        kind == "error", F.concat(F.lit("https://n.example.com/"), F.date_format("ts", "yyyy-MM/dd"), F.lit("/content_1.htm"))
    ).otherwise(F.lit("https://n.example.com/2024-02/31/content_1.htm"))
    rows = read(spark, d, "events").select("event_id", html.alias("html"), url.alias("url"))
    return rows.select(
        "event_id", stamp(extract.publish_time(F.col("html"), F.col("url"), cfg)).alias("publish_time")
    )


@query(
    "page_filters",
    r"""SELECT doc_id FROM documents WHERE split_part(text, chr(10), 1) NOT IN ('of', 'the') AND
    length(regexp_replace(text, '\P{L}', '', 'g')) >= 500""",
)
def page_filters(spark, d):
    docs = read(spark, d, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content")
    )
    kept = extract.min_body(extract.drop_nav(docs, ["of", "the"]), 500, "letters")
    return kept.select("doc_id")


@query(
    "recent_articles",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0 OR o_orderdate >= TIMESTAMP '1998-06-15 12:00:00' - INTERVAL 3 DAY""",
)
def recent_articles(spark, d):
    from articleflow.plans.mapping import orders_articles

    return extract.recent(orders_articles(spark, d), "publish_time", 3, as_of(NOON)).select("id")


@query(
    "web_text",
    r"""SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[·:]+|[·:]+$', '', 'g')) AS cleaned_hash,
    length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS cjk FROM documents""",
)
def web_text(spark, d):
    return read(spark, d, "documents").select(
        "doc_id", sha256(clean_web_text(F.col("text"))).alias("cleaned_hash"), count_cjk(F.col("text")).alias("cjk")
    )
