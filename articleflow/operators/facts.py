"""Source-grounded fact check of summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions.fact_text import (
    EXACT_TYPES,
    FACT_PATTERNS,
    all_matches,
    compatible,
    fact_key,
    percent_value,
)
from articleflow.functions.text import once

# Fixed values.
REPORT_ORDER = ["percent", "year_quarter", "month", "year", "time_range"]
NO_VALUE = "（源文无匹配数值）"
NO_BASIS = "（源文无依据）"
#: The types that are compared with a source; plain numbers are not.
COMPARED = ("percent", *EXACT_TYPES)


def extract(df: DataFrame, col: str, key: str = "doc_id", types: Sequence[str] = tuple(FACT_PATTERNS)) -> DataFrame:
    """(doc_id, fact_type, fact_idx, fact): all facts of a text, or those of some types, in one narrow pass."""

    def typed_facts(fact_type: str) -> Column:
        return F.transform(
            all_matches(F.col(col), fact_type),
            lambda f, i: F.struct(
                F.lit(fact_type).alias("fact_type"), i.cast("long").alias("fact_idx"), f.alias("fact")
            ),
        )

    typed = F.flatten(F.array(*[typed_facts(t) for t in types]))
    return df.select(key, F.explode(typed).alias("_f")).select(key, "_f.*")


def unsupported(candidates: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """Exact candidate facts without an equal source fact of the same type."""
    exact = F.col("fact_type").isin(EXACT_TYPES)
    known = sources.where(exact).select(key, "fact_type", fact_key(F.col("fact")).alias("_key"))
    mine = candidates.where(exact).withColumn("_key", fact_key(F.col("fact")))
    return mine.join(known.distinct(), [key, "fact_type", "_key"], "left_anti").drop("_key")


def unsupported_pct(candidates: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidate percentages without a compatible source value.

    Within a document the distinct source values are one array, so the check is an equi join by
    document and a scan of that array; no pairs are made.
    """
    valued = lambda df: df.where("fact_type = 'percent'").withColumn(
        "_value", percent_value(F.col("fact"))
    ).where("_value is not null")
    values = valued(sources).groupBy(key).agg(F.collect_set("_value").alias("_known"))
    met = valued(candidates).join(values, key, "left")
    known = F.coalesce("_known", F.array().cast("array<double>"))
    return met.where(~F.exists(known, lambda s: compatible(F.col("_value"), s))).drop("_known", "_value")


def violations(candidate: Column, source: Column) -> Column:
    """Messages for all unsupported facts of a candidate; empty when one of the texts is empty."""
    values = lambda text: F.filter(
        F.transform(all_matches(text, "percent"), percent_value), lambda v: v.isNotNull()
    )

    def percentages() -> Column:
        valued = F.transform(
            all_matches(candidate, "percent"),
            lambda f: F.struct(f.alias("f"), percent_value(f).alias("v")),
        )
        sides = F.struct(valued.alias("mine"), values(source).alias("known"))
        lost = once(
            sides,
            lambda x: F.filter(
                x["mine"],
                lambda c: c["v"].isNotNull() & ~F.exists(x["known"], lambda s: compatible(c["v"], s)),
            ),
        )
        return F.transform(lost, lambda c: F.concat(F.lit("percent: "), c["f"], F.lit(NO_VALUE)))

    def exact(fact_type: str) -> Column:
        sides = F.struct(
            all_matches(candidate, fact_type).alias("mine"),
            F.transform(all_matches(source, fact_type), fact_key).alias("known"),
        )
        lost = once(
            sides, lambda x: F.filter(x["mine"], lambda f: ~F.array_contains(x["known"], fact_key(f)))
        )
        return F.transform(lost, lambda f: F.concat(F.lit(f"{fact_type}: "), f, F.lit(NO_BASIS)))

    found = [percentages(), *[exact(t) for t in REPORT_ORDER[1:]]]
    empty = F.array().cast("array<string>")
    usable = (F.coalesce(candidate, F.lit("")) != "") & (F.coalesce(source, F.lit("")) != "")
    return F.when(usable, F.flatten(F.array(*found))).otherwise(empty)


def check(candidates: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, passed, violations): one join by document, then a narrow check."""
    both = candidates.select(key, "candidate").join(sources.select(key, "source_text"), key)
    return both.select(key, violations(F.col("candidate"), F.col("source_text")).alias("violations")).withColumn(
        "passed", F.size("violations") == 0
    )
