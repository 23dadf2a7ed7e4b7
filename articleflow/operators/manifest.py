"""Manifests (source_index, id, token_count) of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(df: DataFrame, limit: int = 512) -> DataFrame:
    """Manifest of the rows strictly below the limit."""
    return df.where(F.col("token_count") < limit).select("source_index", "id", "token_count")


def audit(manifest: DataFrame) -> DataFrame:
    """(check, violations): ids and indexes that occur more than once."""
    def repeated(col: str) -> DataFrame:
        return manifest.groupBy(col).count().where("count > 1").agg(
            F.count(F.lit(1)).alias("violations")
        ).select(F.lit(f"duplicate_{col}").alias("check"), "violations")

    return repeated("id").unionByName(repeated("source_index"))


def rejoin(corpus: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus rows of the manifest, counts of matched, missing and mismatched entries)."""
    entries = manifest.select("source_index", F.col("id").alias("_id"), F.col("token_count").alias("_tokens"))
    met = entries.join(corpus.withColumn("_found", F.lit(True)), "source_index", "left")
    same = F.col("_found") & F.col("_id").eqNullSafe(F.col("id"))
    report = met.agg(
        F.count(F.lit(1)).alias("manifest_rows"),
        F.count_if(same).alias("mapped"),
        F.count_if(F.col("_found").isNull()).alias("index_missing"),
        F.count_if(F.col("_found") & ~F.col("_id").eqNullSafe(F.col("id"))).alias("id_mismatch"),
        F.count_if(same & (F.col("_tokens") != F.col("token_count"))).alias("length_mismatch"),
    )
    return met.where(same).drop("_id", "_found", "_tokens"), report


def require_complete(report: DataFrame) -> DataFrame:
    """The report, or an error unless every entry maps."""
    whole = (F.col("mapped") == F.col("manifest_rows")) & (F.col("length_mismatch") == 0)
    return report.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("manifest does not map")).cast("boolean")))
