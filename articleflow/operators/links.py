"""Links on list pages: discovery, categories, dates, order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.operators.ordering import position


@dataclass(frozen=True)
class LinkRule:
    """How one site writes article links, and what their category key is."""

    pattern: str
    relative: bool
    key: str  # "path" (first path segment) or "host" (first host label)
    date: str  # pattern with groups for the date in the URL
    newest_first: bool
    category_of: tuple[tuple[str, str], ...]


# Fixed values.
SITE_A = LinkRule(
    pattern=r"(/[a-z]+/20\d{6}/[0-9a-f]{32}/c\.html)",
    relative=True,
    key="path",
    date=r"/(20\d{2})(\d{2})(\d{2})/",
    newest_first=True,
    category_of=(
        ("politics", "国内"), ("government", "国内"), ("local", "国内"), ("world", "国际"),
        ("sports", "体育"), ("tech", "科技"), ("digital", "科技"), ("fortune", "财经"),
        ("money", "财经"), ("energy", "财经"), ("legal", "社会"),
    ),
)
SITE_B = LinkRule(
    pattern=r"(https?://[a-z]+\.gmw\.cn/\d{4}-\d{2}/\d{2}/content_\d+\.htm)",
    relative=False,
    key="host",
    date=r"/(\d{4})-(\d{2})/(\d{2})/",
    newest_first=False,
    category_of=(
        ("www", "国内"), ("news", "国内"), ("politics", "国内"), ("world", "国际"),
        ("economy", "财经"), ("sports", "体育"), ("tech", "科技"), ("legal", "社会"),
        ("society", "社会"),
    ),
)


def base_url(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def discover(pages: DataFrame, rule: LinkRule) -> DataFrame:
    """(page_id, pos, link): every link occurrence in page order, made absolute."""
    found = F.regexp_extract_all("html", F.lit(rule.pattern), F.lit(1))
    links = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(found).alias("pos", "link"))
    link = F.concat(base_url(F.col("page_url")), F.col("link")) if rule.relative else F.col("link")
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), link.alias("link"))


def category_key(link: Column, rule: LinkRule) -> Column:
    if rule.key == "host":
        return F.regexp_extract(link, r"^[a-zA-Z]+://([^./?#:]+)", 1)
    return F.regexp_extract(link, r"^[a-zA-Z]+://[^/?#]+/([^/?#]+)", 1)


def dimension(spark: SparkSession, rule: LinkRule) -> DataFrame:
    return spark.createDataFrame(list(rule.category_of), "key string, category string")


def categorise(links: DataFrame, rule: LinkRule) -> DataFrame:
    """Add ``category``; links outside the dimension (a dozen rows, so broadcast) are dropped."""
    keyed = links.withColumn("key", category_key(F.col("link"), rule))
    return keyed.join(F.broadcast(dimension(links.sparkSession, rule)), "key")


def url_date(link: Column, pattern: str) -> Column:
    """Date in a URL, or null where there is none or it does not exist."""
    parts = [F.regexp_extract(link, pattern, i) for i in (1, 2, 3)]
    return F.concat_ws("-", *parts).try_cast("date")


def dedupe(links: DataFrame) -> DataFrame:
    """First occurrence of every URL per category."""
    keys = ["category", "link"]
    rest = [c for c in links.columns if c not in (*keys, "page_id", "pos")]
    first = F.min(F.struct("page_id", "pos", *rest)).alias("_first")
    return links.groupBy(*keys).agg(first).select(*keys, "_first.*")


def with_dates(links: DataFrame, rule: LinkRule, days: int, as_of: Column) -> DataFrame:
    """Add ``link_date`` and keep links whose midnight is not older than ``days`` before ``as_of``."""
    dated = links.withColumn("link_date", url_date(F.col("link"), rule.date))
    recent = F.col("link_date").cast("timestamp_ntz") >= as_of - F.make_interval(days=F.lit(days))
    return dated.where(recent)


def ranked(links: DataFrame, newest_first: bool = False, width: int = 10_000) -> DataFrame:
    """Add ``rank`` inside the category and ``category_order`` (first seen first).

    Six categories may hold everything, so ranks come from bucket offsets, not from one window
    per category.
    """
    block = F.floor(F.col("page_id") / width)
    order = [F.col("page_id"), F.col("pos")]
    bucket = block
    if newest_first:
        age = -F.unix_date("link_date")
        order, bucket = [age, *order], F.struct(age.alias("age"), block.alias("block"))
    placed = position(links, ["category"], order, bucket, "rank")
    seen = links.groupBy("category").agg(F.min(F.struct("page_id", "pos")).alias("category_order"))
    return placed.join(seen, "category")


def round_robin(links: DataFrame, limit: int, newest_first: bool = False, width: int = 10_000) -> DataFrame:
    """Take one article per category in turn until ``limit``; rows with ``ok`` false take no place."""
    turns = ranked(links, newest_first, width).where("ok")
    return turns.orderBy("rank", "category_order").limit(limit)


def today_counts(links: DataFrame, as_of: Column) -> DataFrame:
    """Distinct links per category whose URL carries today's date."""
    today = links.where(F.col("link_date") == F.to_date(as_of))
    return today.groupBy("category").agg(F.count_distinct("link").alias("found_today"))
