"""Tokens, n-grams and F scores for summary evaluation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from articleflow.functions.text import SPACE

TOKEN = rf"[A-Za-z0-9]+|[^{SPACE[1:-1]}]"


def tokens(col: Column) -> Column:
    """ASCII words in lower case, every other visible character on its own."""
    lowered = F.translate(F.coalesce(col, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))


def _grams(tokens: list[str], n: int) -> Iterable:
    return tokens if n == 1 else zip(*(tokens[k:] for k in range(n)))


def _common_grams(predictions: Iterable[str], references: Iterable[str], orders: Sequence[int]) -> list[int]:
    """Per order: common n-grams of two multisets, and the size of both; a text has one token per line."""
    mine, known = ([t.split("\n") for t in texts if t] for texts in (predictions, references))
    counts = []
    for n in orders:
        expected = Counter(g for t in known for g in _grams(t, n))
        met = Counter(g for t in mine for g in _grams(t, n) if g in expected)
        common = sum(min(c, expected[g]) for g, c in met.items())
        counts += [common, sum(max(0, len(t) - n + 1) for t in mine), expected.total()]
    return counts


def common_grams(orders: Sequence[int]) -> Callable[..., Column]:
    """For arrays of predictions and references with one token per line: the numbers of ``_common_grams``."""

    @F.pandas_udf(ArrayType(LongType()))
    def counted(predictions: pd.Series, references: pd.Series) -> pd.Series:
        return pd.Series([_common_grams(p, r, orders) for p, r in zip(predictions, references)], dtype="object")

    return counted


def f_score(overlap: Column, predicted: Column, expected: Column) -> Column:
    precision, recall = overlap / predicted, overlap / expected
    usable = (overlap > 0) & (predicted > 0) & (expected > 0)
    return F.when(usable, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def _common_length(left: list[str], right: list[str]) -> int:
    """Longest common subsequence by the published bit-vector method (Hyyrö, 2004).

    The shorter text makes the bits, so a long text against a short one costs one pass.
    """
    if len(left) > len(right):
        left, right = right, left
    if not left:
        return 0
    where: dict[str, int] = {}
    for i, token in enumerate(left):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(left)) - 1
    row = full
    for token in right:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


@F.pandas_udf(LongType())
def common_length(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two texts with one token per line."""
    return pd.Series(
        [_common_length(a.split("\n") if a else [], b.split("\n") if b else []) for a, b in zip(left, right)],
        dtype="int64",
    )
