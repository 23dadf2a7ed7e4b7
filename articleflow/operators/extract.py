"""Raw pages to articles; one narrow pass per page, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions import html as H
from articleflow.functions.text import SPACE, count_script, strip
from articleflow.operators.links import SITE_A, SITE_B, url_date


@dataclass(frozen=True)
class SourceConfig:
    """What is special about the article pages of one site."""

    name: str
    containers: tuple[str, ...]
    suffixes: tuple[str, ...]
    date_pattern: str
    title_tag_first: bool = False
    seconds: bool = True
    meta_date: bool = False
    nav_titles: tuple[str, ...] = ()
    min_body: int = 60
    script: str = "cjk"
    keep_days: int = 3


# Fixed values.
SOURCE_A = SourceConfig(
    name="新华网",
    containers=("div.main-left", "div.main", "div.content"),
    suffixes=("-新华网",),
    date_pattern=SITE_A.date,
)
SOURCE_B = SourceConfig(
    name="光明网",
    containers=("#article_inbox", "div.con-text", "div.u-mainText", "div.g-main"),
    suffixes=(" _光明网", " - 光明网", "｜光明网", "_光明网"),
    date_pattern=SITE_B.date,
    title_tag_first=True,
    seconds=False,
    meta_date=True,
    nav_titles=("全部导航", "光明网导航", "网站地图", "栏目导航"),
)


def paragraphs(pages: DataFrame, rules: Sequence[str], min_chars: int = H.MIN_PARAGRAPH) -> DataFrame:
    """(page_id, p_idx, text): body paragraphs in page order."""
    found = H.body_paragraphs(F.col("html"), rules, min_chars)
    return pages.select("page_id", F.posexplode(found).alias("p_idx", "text")).withColumn(
        "p_idx", F.col("p_idx").cast("long")
    )


def dedupe_paragraphs(rows: DataFrame) -> DataFrame:
    """First copy of every text per page, for paragraphs that already are rows."""
    return rows.groupBy("page_id", "text").agg(F.min("p_idx").alias("p_idx"))


def assemble(rows: DataFrame) -> DataFrame:
    """(page_id, content) from paragraph rows; a page's paragraphs came out of one row."""
    ordered = F.array_sort(F.collect_list(F.struct("p_idx", "text")))
    return rows.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("content")
    )


def drop_nav(df: DataFrame, titles: Sequence[str]) -> DataFrame:
    return df.where(~F.col("title").isin(list(titles)))


def min_body(df: DataFrame, n: int = 60, script: str = "cjk") -> DataFrame:
    return df.where(count_script(F.col("content"), script) >= n)


def is_recent(ts: Column, days: int, as_of: Column) -> Column:
    return ts.isNull() | (ts >= as_of - F.make_interval(days=F.lit(days)))


def recent(df: DataFrame, ts: str, days: int, as_of: Column) -> DataFrame:
    return df.where(is_recent(F.col(ts), days, as_of))


def publish_time(html: Column, url: Column, cfg: SourceConfig) -> Column:
    """First valid visible time, then the meta date, then the date in the URL, else null."""
    seconds = r"(?::\d{2})?" if cfg.seconds else ""
    shown = F.regexp_extract_all(html, F.lit(rf"20\d{{2}}-\d{{2}}-\d{{2}}{SPACE}+\d{{2}}:\d{{2}}{seconds}"), F.lit(0))
    times = F.transform(
        shown, lambda t: F.regexp_replace(t, f"{SPACE}+", " ").try_cast("timestamp_ntz")
    )
    visible = F.get(F.filter(times, lambda t: t.isNotNull()), 0)
    meta = F.lit(None).cast("timestamp_ntz")
    if cfg.meta_date:
        found = F.regexp_extract(
            html, r'<meta[^>]+name="publishdate"[^>]+content="(\d{4}-\d{2}-\d{2})"', 1
        )
        meta = found.try_cast("timestamp_ntz")
    return F.coalesce(visible, meta, url_date(url, cfg.date_pattern).cast("timestamp_ntz"))


def title(html: Column, cfg: SourceConfig) -> Column:
    if not cfg.title_tag_first:
        return H.title(html, cfg.suffixes)
    first = strip(H.strip_suffix(H.title_element(html), cfg.suffixes))
    return F.when(first != "", first).otherwise(H.title(html))


def examine(pages: DataFrame, cfg: SourceConfig, as_of: Column) -> DataFrame:
    """Every page with its article columns and ``reject_reason`` (null: accepted)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    body = F.array_join(H.body_paragraphs(html, cfg.containers), "\n")
    parsed = pages.withColumns(
        {
            "content": body,
            "title": title(html, cfg),
            "publish_time": publish_time(html, F.col("url"), cfg),
        }
    )
    nav = H.title_element(html).isin(list(cfg.nav_titles)) if cfg.nav_titles else F.lit(False)
    reason = (
        F.when(html == "", "no_html")
        .when(count_script(F.col("content"), cfg.script) < cfg.min_body, "short_body")
        .when(nav, "nav_page")
        .when(F.col("title") == "", "no_title")
        .when(~is_recent(F.col("publish_time"), cfg.keep_days, as_of), "old")
    )
    return parsed.withColumn("reject_reason", reason)


def build_articles(pages: DataFrame, cfg: SourceConfig, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(articles of the source, rejected pages with reason) from (page_id, url, html, category)."""
    seen = examine(pages, cfg, as_of)
    articles = seen.where("reject_reason is null").select(
        F.col("page_id").alias("seq"),
        "title",
        "content",
        "category",
        F.lit(cfg.name).alias("source"),
        F.col("url").alias("source_url"),
        "publish_time",
    )
    rejected = seen.where("reject_reason is not null").select("page_id", "url", "reject_reason")
    return articles, rejected
