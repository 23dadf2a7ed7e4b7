"""Typographic clean-up of generated summaries; facts and numbers never change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow.functions.text import SPACE, strip

H = "一-鿿"
# Fixed values, applied in this order: (pattern, replacement).
DECIMAL_AND_PERCENT = [
    (rf"(?<=\p{{Nd}}){SPACE}*\.{SPACE}*(?=\p{{Nd}})", "."),
    (rf"{SPACE}*%", "%"),
]
SPACES_IN_HAN = [
    (rf"(?<=[{H}]){SPACE}+(?=[{H}])", ""),
    (rf"(?<=[{H}]){SPACE}+(?=[，。；：！？、）】》])", ""),
    (rf"(?<=[（【《]){SPACE}+(?=[{H}])", ""),
]
PUNCTUATION = [
    (rf"(?<=[{H}，。；：！？]){SPACE}*,{SPACE}*(?=[{H}（【])", "，"),
    (rf"(?<=[{H}，。；：！？]){SPACE}*;{SPACE}*(?=[{H}（【])", "；"),
    (rf"(?<=[{H}]){SPACE}*[:：]{SPACE}*(?=[{H}0-9（【\"'])", "："),
    (rf"(?<=[{H}，；]){SPACE}*[.](?={SPACE}*(?:[{H}（【]|\n?\z))", "。"),
]
COMMA_AFTER_NUMBER = [(rf"(?<=[0-9%]){SPACE}*,{SPACE}*(?=[{H}])", "，")]
SPACE_AFTER_MARK = [(r"(?<=[，。；：！？、）】]) +", "")]


def _apply(col: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def normalise_summary(col: Column) -> Column:
    """Seven ordered stages; null and empty give an empty string."""
    out = _apply(F.coalesce(col, F.lit("")), DECIMAL_AND_PERCENT)
    out = _apply(out, SPACES_IN_HAN)
    out = _apply(out, PUNCTUATION)
    out = strip(F.regexp_replace(out, f"{SPACE}+", " "))
    out = _apply(out, COMMA_AFTER_NUMBER)
    out = _apply(out, SPACES_IN_HAN)
    return _apply(out, SPACE_AFTER_MARK)
