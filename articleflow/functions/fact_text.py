"""Checkable facts in a text: percentages, months, years, quarters, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow.functions.text import SPACE, once, strip

# Fact type -> patterns, in reporting order.
FACT_PATTERNS = {
    "year_quarter": ["20[0-2][0-9]年[一二三四]季度"],
    "percent": [
        r"[0-9]+(?:\.[0-9]+)?%",
        "百分之[零一二三四五六七八九十百千万点]+",
        r"[超约近]?[0-9]+(?:\.[0-9]+)?[成]",
        "[超约近]?[一二三四五六七八九十]+[成]",
    ],
    "month": ["[0-9]{1,2}月", "[一二三四五六七八九十]{1,3}月"],
    "year": ["20[0-2][0-9]年", "19[0-9]{2}年"],
    "time_range": ["上半年", "下半年", "第一季度", "第二季度", "第三季度", "第四季度", "[一二三四]季度"],
    "number": [r"[0-9]+(?:\.[0-9]+)?", "[零一二三四五六七八九十百千万亿]+"],
}
#: What every match of a pattern holds: texts without it need no search. None where nothing is sure.
FACT_MARKS = {
    "year_quarter": ["季度"],
    "percent": ["%", "百分之", "成", "成"],
    "month": ["月", "月"],
    "year": ["年", "年"],
    "time_range": ["上半年", "下半年", "第一季度", "第二季度", "第三季度", "第四季度", "季度"],
    "number": [None, None],
}
EXACT_TYPES = ["year_quarter", "month", "year", "time_range"]
APPROXIMATORS = ["超", "约", "近", "超过", "将近", "不到", "高于", "低于"]
DIGITS = "零一二三四五六七八九"
FULL_WIDTH_DIGITS = "０１２３４５６７８９"
TOLERANCE = 0.15


def all_matches(col: Column, fact_type: str) -> Column:
    """Every match of a fact type, pattern by pattern, in text order."""
    text = F.coalesce(col, F.lit(""))

    def matches(pattern: str, mark: str | None) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return found if mark is None else F.when(text.contains(mark), found).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*map(matches, FACT_PATTERNS[fact_type], FACT_MARKS[fact_type])))


def fact_key(col: Column) -> Column:
    """The form in which two exact facts are compared."""
    folded = F.translate(col, FULL_WIDTH_DIGITS, "0123456789")
    return F.regexp_replace(F.regexp_replace(folded, f"{SPACE}+", ""), r"%+\z", "")


def percent_value(col: Column) -> Column:
    """A percentage as a number, or null: ``4.5%``, ``百分之四点五``, ``4成``, ``四成``."""
    return once(
        F.regexp_replace(strip(col), "^(?:" + "|".join(APPROXIMATORS) + ")", ""), _percent_number
    )


def _percent_number(text: Column) -> Column:
    number = r"([0-9]+(?:\.[0-9]+)?)"
    western = F.regexp_extract(text, rf"^{number}%\z", 1)
    tenths = F.regexp_extract(text, rf"^{number}成\z", 1)
    tenth_word = F.regexp_extract(text, r"^([一二三四五六七八九])成\z", 1)
    words = F.regexp_extract(text, r"^百分之(.+)\z", 1)
    digits_only = lambda c: F.translate(
        F.regexp_replace(c, f"[^{DIGITS}]", ""), DIGITS, "0123456789"
    )
    whole = F.when(words.contains("点"), F.substring_index(words, "点", 1)).otherwise(words)
    after = F.substring(F.regexp_extract(words, "点(.*)", 1), 1, 1)
    spoken = F.concat(F.lit("0"), digits_only(whole)).cast("double") + F.coalesce(
        digits_only(after).try_cast("double"), F.lit(0.0)
    ) / 10
    return (
        F.when(western != "", western.try_cast("double"))
        .when(tenths != "", tenths.try_cast("double") * 10)
        .when(tenth_word != "", digits_only(tenth_word).try_cast("double") * 10)
        .when(words != "", spoken)
    )


def compatible(candidate: Column, source: Column) -> Column:
    """Within 15 % of the source value; a source value of zero matches zero only."""
    near = F.abs(candidate - source) / F.abs(F.nullif(source, F.lit(0.0))) < TOLERANCE
    return F.when(source == 0, candidate == 0).otherwise(near)
