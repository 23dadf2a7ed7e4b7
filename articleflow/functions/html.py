"""HTML expressions without a DOM: noise removal, containers, paragraphs, titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow.functions.text import clean_web_text, count_cjk, once, unescape

# Fixed values.
NOISE_TAGS = ["script", "style", "noscript", "iframe", "nav", "aside", "form", "footer", "svg"]
MIN_PARAGRAPH = 20
CAPTION_CJK_LIMIT = 160
CAPTION_MIDDLE = r"（(?:20\d{2}年\d{1,2}月\d{1,2}日摄|无人机照片|资料图)[^）]*）"
CAPTION_END = (
    r"(?:新华社发(?:（[^）]{0,20}摄）)?|中新社发"
    r"|新华社记者[一-鿿·\s]{0,12}摄|(?:记者|通讯员)[一-鿿·\s]{0,8}摄)\z"
)
NEWSPAPER_LINE = (
    r"《[一-鿿]{2,12}(?:日报|时报|晚报|报)》?[（(]"
    r"\s*20\d{2}年\d{1,2}月\d{1,2}日\s+\d+版\s*[)）]\s*\z"
)
# Tags that end an open paragraph.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header"
    "|hr|html|li|main|nav|ol|pre|section|table|tbody|td|th|tr|ul"
)


def strip_blocks(col: Column, tags: Sequence[str] = NOISE_TAGS) -> Column:
    """Drop whole noise elements, nested ones included, and comments.

    The page is cut in front of every noise tag; one pass over the cuts keeps track of the open
    element, so the cost is linear and no regular expression backtracks over the page.
    """
    names = "|".join(tags)
    pieces = F.split(col, rf"(?i)(?=</?(?:{names})[\s>/])|(?=<!--)|(?=-->)")

    def describe(piece: Column) -> Column:
        """Piece, the noise tag it begins with, +1 start or -1 end, and the text behind the tag."""
        tag = F.lower(F.regexp_extract(piece, rf"(?i)^</?({names})[\s>/]", 1))
        marked = F.struct(piece.alias("p"), tag.alias("t"))
        return once(
            marked,
            lambda m: F.struct(
                m["p"].alias("p"),
                F.when(m["p"].startswith("<!--") | m["p"].startswith("-->"), "!--").otherwise(m["t"]).alias("t"),
                F.when(m["p"].startswith("-->") | m["p"].startswith("</"), -1)
                .when((m["t"] == "svg") & m["p"].rlike("^<[^>]*/>"), 0)
                .otherwise(1)
                .alias("k"),
                F.when(m["p"].startswith("-->"), F.substring(m["p"], 4, 1 << 30))
                .when(m["t"] != "", F.regexp_replace(m["p"], "^<[^>]*>?", ""))
                .otherwise("")
                .alias("rest"),
            ),
        )

    def step(acc: Column, x: Column) -> Column:
        outside = acc["depth"] == 0
        starts = (x["t"] != "") & (x["k"] == 1)
        same = x["t"] == acc["open"]
        nested = same & starts & (x["t"] != "!--")
        depth = (
            F.when(outside, F.when(starts, 1).otherwise(0))
            .when(nested, acc["depth"] + 1)
            .when(same & (x["k"] == -1), acc["depth"] - 1)
            .otherwise(acc["depth"])
        )
        kept = (
            F.when(outside & starts, "")
            .when(outside & ((x["t"] == "") | (x["t"] == "!--")), x["p"])
            .when(outside, x["rest"])
            .when((acc["depth"] == 1) & same & (x["k"] == -1), x["rest"])
            .otherwise("")
        )
        return F.struct(
            F.when(outside & starts, x["t"]).otherwise(acc["open"]).alias("open"),
            depth.alias("depth"),
            F.concat(acc["out"], F.filter(F.array(kept), lambda k: k != "")).alias("out"),
        )

    start = F.struct(
        F.lit("").alias("open"),
        F.lit(0).alias("depth"),
        F.array().cast("array<string>").alias("out"),
    )
    walked = F.reduce(F.transform(pieces, describe), start, step, lambda acc: acc["out"])
    return F.array_join(walked, "")


def _opening(rule: str) -> str:
    """Pattern of the opening tag of ``tag``, ``tag.class`` or ``#id``; group 1 is the tag name."""
    if rule.startswith("#"):
        return rf"<([a-zA-Z][a-zA-Z0-9]*)\b[^>]*\bid\s*=\s*[\"']?{rule[1:]}(?=[\s\"'>])[^>]*>"
    tag, _, css = rule.partition(".")
    if css:
        return rf"<({tag})\b[^>]*\bclass\s*=\s*[\"']?(?:[^\"'>]*\s)?{css}(?=[\s\"'>])[^>]*>"
    return rf"<({tag})(?=[\s>])[^>]*>"


def _balanced(rest: Column, tag: Column) -> Column:
    """The part of ``rest`` up to the end tag that closes an element opened just before it."""
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"[\s>/])")))
    changes = F.transform(
        pieces,
        lambda p, i: F.when(p.startswith("</"), -1)
        .when((i > 0) | F.regexp_like(p, F.concat(F.lit("(?i)^<"), tag, F.lit(r"[\s>/]"))), 1)
        .otherwise(0),
    )

    def step(acc: Column, change: Column) -> Column:
        depth = F.when(acc["depth"] > 0, acc["depth"] + change).otherwise(0)
        return F.struct(
            depth.alias("depth"), (acc["keep"] + F.when(depth > 0, 1).otherwise(0)).alias("keep")
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("keep"))
    keep = F.reduce(changes, start, step, lambda acc: acc["keep"])
    return once(pieces, lambda ps: F.array_join(F.slice(ps, F.lit(1), keep), ""))


def container(col: Column, rules: Sequence[str]) -> Column:
    """Inside of the first rule that matches, else the whole page."""

    def inside(page: Column, opening: str) -> Column:
        tag = F.regexp_extract(page, opening, 1)
        rest = F.regexp_extract(page, f"{opening}(.*)", 2)
        parts = F.struct(rest.alias("rest"), tag.alias("tag"))
        return once(parts, lambda x: _balanced(x["rest"], x["tag"]))

    def choose(page: Column) -> Column:
        out = page
        for rule in reversed(rules):
            opening = f"(?is){_opening(rule)}"
            out = F.when(page.rlike(opening), inside(page, opening)).otherwise(out)
        return out

    return once(col, choose)


def plain(col: Column) -> Column:
    """Text of a fragment: tags become spaces, references are decoded."""
    return unescape(F.regexp_replace(col, r"(?s)<[^>]*>?", " "))


def paragraph_texts(col: Column) -> Column:
    """Cleaned text of every paragraph in order; an unclosed one ends at the next block tag."""
    chunks = F.split(col, r"(?i)<p(?:\s[^>]*)?>")
    bodies = F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0)))
    cut = rf"(?is)</p\s*>.*|</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>.*"
    return F.transform(bodies, lambda b: clean_web_text(plain(F.regexp_replace(b, cut, ""))))


def is_caption(col: Column) -> Column:
    tail = (col.endswith("摄") | col.endswith("摄）")) & (count_cjk(col) <= CAPTION_CJK_LIMIT)
    return col.rlike(CAPTION_MIDDLE) | col.rlike(CAPTION_END) | tail


def is_newspaper_line(col: Column) -> Column:
    return col.rlike(NEWSPAPER_LINE)


def body_paragraphs(col: Column, rules: Sequence[str], min_chars: int = MIN_PARAGRAPH) -> Column:
    """Article paragraphs: long enough, no captions or source lines, first copies only."""
    texts = paragraph_texts(container(strip_blocks(col), rules))
    kept = F.filter(
        texts,
        lambda t: (F.length(t) >= min_chars) & ~is_caption(t) & ~is_newspaper_line(t),
    )
    return F.array_distinct(kept)


def _element(col: Column, tag: str) -> Column:
    found = F.regexp_extract(col, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    return F.nullif(F.trim(F.regexp_replace(plain(found), r"\s+", " ")), F.lit(""))


def _meta(col: Column, attribute: str) -> Column:
    tag = F.regexp_extract(col, rf"(?is)<meta\b[^>]*\b{attribute}\s*=\s*[\"']og:title[\"'][^>]*>", 0)
    content = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.nullif(unescape(F.substring(content, F.lit(2), F.length(content) - 2)), F.lit(""))


def strip_suffix(col: Column, suffixes: Sequence[str]) -> Column:
    """Remove the first of the suffixes that fits; one at most."""

    def cut(text: Column) -> Column:
        out = text
        for suffix in reversed(suffixes):
            shorter = F.substring(text, F.lit(1), F.length(text) - len(suffix))
            out = F.when(text.endswith(suffix), shorter).otherwise(out)
        return out

    return once(col, cut) if suffixes else col


def title_element(col: Column) -> Column:
    """The cleaned ``<title>``, or an empty string."""
    return F.coalesce(clean_web_text(_element(col, "title")), F.lit(""))


def title(col: Column, suffixes: Sequence[str] = ()) -> Column:
    """og:title, then h1, h2 and title; references decoded, one site suffix removed."""
    found = F.coalesce(
        _meta(col, "property"),
        _meta(col, "name"),
        _element(col, "h1"),
        _element(col, "h2"),
        _element(col, "title"),
        F.lit(""),
    )
    return clean_web_text(strip_suffix(unescape(found), suffixes))
