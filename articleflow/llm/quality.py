"""Quality rules: a decision list learned from labelled statistics, in DataFrame functions only.

Sequential covering: a rule for low quality grows one threshold at a time by information gain on one half of
the labelled rows, is cut back on the other half, and the rows it covers are set aside. Counts by threshold
are all that the driver sees, so all labelled rows take part. Rules become one ordered Spark expression.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import staged

BLANKS = " \t\n\v\f\r"
#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "loud_share", "digit_share")
#: Quantiles of each group of rows that become limits; four groups a feature.
CUTS = 64
MAX_RULES, MAX_CONDITIONS = 10, 4
#: A rule must be this pure on rows it was not grown on, and cover that many low ones there.
LEAST_PURITY, LEAST_COVER = 0.95, 5


def _count(text: Column, characters: str) -> Column:
    """How many characters of a text are among these."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column, width: int = 5) -> Column:
    """Words inside windows that occur twice or more, each word once.

    Window hashes are sorted with their positions, so a text costs n log n; without a repeat it is one set.
    """

    def of_windows(hashes: Column) -> Column:
        def of_pairs(pairs: Column) -> Column:
            n = F.size(pairs)
            same = lambda i, j: F.get(pairs, i)["h"].eqNullSafe(F.get(pairs, j)["h"])
            places = F.array_sort(F.transform(
                F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1))),
                lambda i: F.get(pairs, i)["at"],
            ))
            return _bind(places, lambda p: F.aggregate(
                p, F.struct(F.lit(0).alias("total"), F.lit(-width).alias("last")),
                lambda acc, at: F.struct((acc["total"] + F.least(F.lit(width), at - acc["last"])).alias("total"), at.alias("last")),
                lambda acc: acc["total"],
            ))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_bind(pairs, of_pairs))

    def of_hashes(each: Column) -> Column:
        parts = [lambda i, k=k: F.get(each, i + k) for k in range(width)]
        windows = F.transform(F.sequence(F.lit(0), F.size(each) - width), lambda i: F.xxhash64(*(p(i) for p in parts)))
        return F.when(F.size(each) < width + 1, 0).otherwise(_bind(windows, of_windows))

    return _bind(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and statistics of every whole text; a null text is empty. Repeated rows stay, other columns are not read."""
    text = F.coalesce("text", F.lit(""))
    blank = F.translate(text, BLANKS, " " * len(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    read = documents.select(
        "doc_id",
        F.array_remove(F.split(blank, " "), "").alias("_words"),
        lines.alias("_lines"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        _count(text, CAPITALS).cast("long").alias("_capitals"),
        _count(text, "!").cast("long").alias("_loud"),
        _count(text, "0123456789").cast("long").alias("_digits"),
    )
    counted = read.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"), "_capitals", "_loud", "_digits",
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("word_length"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_capitals", "word_chars").alias("capital_share"), share("_loud", "word_chars").alias("loud_share"),
        share("_digits", "word_chars").alias("digit_share"),
    )


@dataclass(frozen=True)
class Condition:
    """``feature >= limit``, or ``feature < limit`` when not ``above``."""

    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value >= self.limit if self.above else value < self.limit


Rule = tuple[Condition, ...]


def fires(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule))


def verdict(rules: Sequence[Rule]) -> Column:
    """False where a rule of the list fires, in order, else true."""
    if not rules:
        return F.lit(True)
    listed = F.when(fires(rules[0]), False)
    for rule in rules[1:]:
        listed = listed.when(fires(rule), False)
    return listed.otherwise(True)


def _counts(rows: DataFrame, features: Sequence[str]) -> dict:
    """low and high rows at or above each limit, by (half, feature): one aggregation for all candidates."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col("bins")[i].alias("bin")) for i in range(len(features)))))
    found = rows.select("half", "low", cells.alias("c")).groupBy("half", "c.f", "c.bin").agg(
        F.sum("low").alias("low"), F.sum(1 - F.col("low")).alias("high")
    ).collect()  # halves x features x bins
    by: dict = defaultdict(lambda: defaultdict(lambda: (0, 0)))
    for r in found:
        by[(r["half"], r["f"])][r["bin"]] = (r["low"], r["high"])
    return by


def learn(statistics: DataFrame, labels: DataFrame, features: Sequence[str] = FEATURES) -> list[Rule]:
    """Rules for low quality (label 0) from all labelled rows; no rules without both labels."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    joined = staged(
        statistics.join(known, "doc_id").select(*(F.col(f).cast("double").alias(f) for f in features), F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("_third"), "_quality"),
        "quality-rows",
    )
    def cuts(value: Column) -> Column:
        return F.coalesce(F.percentile_approx(value, [i / CUTS for i in range(CUTS)], 10000), F.array().cast("array<double>"))

    def limits_of(feature: str) -> Column:
        """Quantiles of all rows, of low ones, and of both where the value is not zero: mostly-zero statistics have limits in their tails."""
        value, low = F.col(feature), F.col("_quality") == 0
        groups = (value, F.when(low, value), F.when(value != 0, value), F.when(low & (value != 0), value))
        return F.array_sort(F.array_distinct(F.concat(*map(cuts, groups))))

    limits = joined.agg(*(limits_of(f).alias(f) for f in features)).first()
    if not limits[0]:
        return []

    def bin_of(feature: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, limits[feature])), lambda t: F.col(feature) >= t))

    bins = F.array(*map(bin_of, features))
    rest = staged(joined.select(F.when(F.col("_third") == 0, 1).otherwise(0).alias("half"), (1 - F.col("_quality")).cast("int").alias("low"), bins.alias("bins")), "quality-bins")
    rules: list[Rule] = []

    def hit(conditions) -> Column:
        return reduce(lambda a, b: a & b, ((F.col("bins")[i] >= k if above else F.col("bins")[i] < k) for i, above, k in conditions))

    def gain(now: tuple[int, int], then: tuple[int, int]) -> float:
        if not then[0] or not now[0]:
            return 0.0
        return then[0] * (math.log2(then[0] / sum(then)) - math.log2(now[0] / sum(now)))

    while len(rules) < MAX_RULES:
        grown: list[tuple[int, bool, int]] = []
        purities: list[tuple[float, int]] = []
        while len(grown) < MAX_CONDITIONS:
            by = _counts(rest.where(hit(grown)) if grown else rest, features)
            best = None
            for i, f in enumerate(features):
                total = [tuple(map(sum, zip(*by[(half, i)].values(), strict=True))) or (0, 0) for half in (0, 1)]
                above = [(0, 0), (0, 0)]
                for k in range(len(limits[f]), 0, -1):
                    above = [tuple(map(sum, zip(above[h], by[(h, i)][k], strict=True))) for h in (0, 1)]
                    for side, pair in ((True, above), (False, [tuple(t - a for t, a in zip(total[h], above[h], strict=True)) for h in (0, 1)])):
                        score = gain(total[0], pair[0])
                        if score > 1e-9 and (best is None or score > best[0]):
                            best = (score, (i, side, k), pair)
            if best is None:
                break
            grown.append(best[1])
            low, high = best[2][1]
            purities.append((low / (low + high) if low >= LEAST_COVER else 0.0, low))
            if best[2][0][1] == 0:
                break
        pure = [n for n, (p, _) in enumerate(purities, 1) if p >= LEAST_PURITY]
        if not pure:
            break
        kept = grown[: max(pure, key=lambda n: (purities[n - 1][1], -n))]  # cut back to the widest pure rule
        rules.append(tuple(Condition(features[i], above, float(limits[features[i]][k - 1])) for i, above, k in kept))
        rest = rest.where(~hit(kept))
    return rules
