"""Registry of evaluation and benchmark run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.sources.schemas import RUNS


# Types of values, by their name in a variant's schema, that a field of a record may hold.
ACCEPTED = {
    "string": "^STRING$",
    "boolean": "^BOOLEAN$",
    "bigint": "^BIGINT$",
    "double": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
}


def _records(spark: SparkSession, pattern: str, multi_line: bool) -> DataFrame:
    """Readable records as variants: objects with a run id."""
    read = spark.read.schema("_record variant").option("singleVariantColumn", "_record").option("multiLine", multi_line)
    return read.json(pattern).where(_fits("run_id", "string"))


def _held(name: str) -> Column:
    """Type name of a field's value; null where the field is absent."""
    return F.schema_of_variant(F.try_variant_get("_record", f"$.{name}", "variant"))


def _fits(name: str, kind: str) -> Column:
    return F.coalesce(_held(name).rlike(ACCEPTED[kind]), F.lit(False))


def _kinds() -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in RUNS.fields}


def read(spark: SparkSession, pattern: str, multi_line: bool = True) -> DataFrame:
    """All readable run records under a glob; unreadable ones, and those without a run id, are skipped.

    Fields are typed one by one: a value of another type (5.5 or "5" for a count) is null, and its record stays.
    ``refused`` counts such values. A record that repeats a key is unreadable.
    """
    return _records(spark, pattern, multi_line).select(
        *[
            F.when(_fits(name, kind), F.try_variant_get("_record", f"$.{name}", kind)).alias(name)
            for name, kind in _kinds().items()
        ]
    )


def refused(spark: SparkSession, pattern: str, multi_line: bool = True) -> DataFrame:
    """(field, refused): how many records hold a value of a wrong type there; null is no value."""
    wrong = {
        name: F.count_if(F.coalesce(_held(name) != "VOID", F.lit(False)) & ~_fits(name, kind))
        for name, kind in _kinds().items()
    }
    counts = _records(spark, pattern, multi_line).agg(*[n.alias(name) for name, n in wrong.items()])
    return counts.unpivot([], list(wrong), "field", "refused")


def latest(runs: DataFrame, predicate: Column) -> DataFrame:
    """The run with the greatest name among those that match."""
    return runs.where(predicate).orderBy(F.col("run_id").desc()).limit(1)


# Task names, statuses and profiles below are fixed values of the run records.
def accepted_quality() -> Column:
    return (
        F.col("task").isin("B2-10", "B6-01")
        & F.col("formal_result")
        & (F.col("acceptance_status") == "passed")
    )


def accepted_benchmark() -> Column:
    return (F.col("task") == "B2-14") & F.col("formal_result") & (F.col("acceptance_status") == "passed")


def sampled(task: str) -> Column:
    return (
        (F.col("task") == task)
        & (F.col("evaluation_profile") == "course_sampled")
        & F.col("status").isin("completed", "acceptance_failed")
    )
