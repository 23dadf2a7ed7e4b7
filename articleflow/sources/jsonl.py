"""JSON-lines files: one status per physical line, nothing dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions.text import is_blank, strip
from articleflow.operators.ordering import position


def classify(df: DataFrame, raw: str) -> DataFrame:
    """Add ``record`` (variant) and ``status``: ok, empty_line, json_decode or not_dict."""
    return df.withColumn("record", F.try_parse_json(strip(F.col(raw)))).withColumn(
        "status",
        F.when(is_blank(F.col(raw)), "empty_line")
        .when(F.col("record").isNull(), "json_decode")
        .when(F.schema_of_variant("record").startswith("OBJECT"), "ok")
        .otherwise("not_dict"),
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, status, raw, record) of every line; tolerant of bad lines and BOM.

    Files are split as usual. A line's number is its rank inside its file block plus the line
    counts of earlier blocks of the file.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
            F.col("value").alias("raw"),
        )
    )
    numbered = position(lines, ["source_file"], [F.col("_row")], F.col("_block"), "line_no")
    first = F.regexp_replace("raw", "^﻿", "")
    numbered = numbered.withColumn("raw", F.when(F.col("line_no") == 1, first).otherwise(F.col("raw")))
    return classify(numbered, "raw").select("source_file", "line_no", "status", "raw", "record")


def _refuse(bad: Column, message: Column) -> Column:
    return F.when(bad, F.raise_error(message))


def strict(scanned: DataFrame) -> DataFrame:
    """Abort with file and line on the first bad line, empty article or empty summary."""
    where = F.concat_ws(":", "source_file", "line_no", "status")
    sentences = F.try_variant_get("record", "$.article", "array<string>")
    summary = F.try_variant_get("record", "$.summary", "string")
    hollow = F.coalesce(is_blank(F.array_join(sentences, " ")), F.lit(True)) | is_blank(summary)
    problem = F.coalesce(
        _refuse(F.col("status") != "ok", where).cast("boolean"),
        _refuse(hollow, F.concat(where, F.lit(": empty article or summary"))).cast("boolean"),
        F.lit(True),
    )
    return scanned.where(problem)


def scan_strict(spark: SparkSession, path: str) -> DataFrame:
    return strict(scan(spark, path))
