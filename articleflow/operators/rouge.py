"""ROUGE-1, ROUGE-2 and ROUGE-L of predictions against references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.functions.rouge_text import common_grams, common_length, f_score, tokens
from articleflow.functions.text import is_blank
from articleflow.session import by_key

ORDERS = (1, 2)


def overlap(pairs: DataFrame, orders: tuple[int, ...] = ORDERS, key: str = "id") -> DataFrame:
    """(id, overlap{n}, predicted{n}, expected{n}): n-gram multiset overlap per id.

    Rows with (id, prediction, reference) are placed by id while they are still compact text. The n-grams are counted
    in the task that made them, and only those that a reference holds are ever gathered: no n-gram is a row.
    """
    placed = by_key(pairs.select(key, "prediction", "reference"), key)
    lines = lambda name: F.array_join(tokens(F.col(name)), "\n")
    lists = placed.select(key, lines("prediction").alias("_p"), lines("reference").alias("_r")).groupBy(key).agg(
        F.collect_list("_p").alias("_p"), F.collect_list("_r").alias("_r")
    )
    counted = lists.select(key, common_grams(orders)(F.col("_p"), F.col("_r")).alias("_n"))
    names = [f"{name}{n}" for n in orders for name in ("overlap", "predicted", "expected")]
    return counted.select(key, *(F.get("_n", F.lit(i)).alias(name) for i, name in enumerate(names)))


def n(pairs: DataFrame, order: int, key: str = "id") -> DataFrame:
    """(id, rouge{order})."""
    found = overlap(pairs, (order,), key)
    score = f_score(F.col(f"overlap{order}"), F.col(f"predicted{order}"), F.col(f"expected{order}"))
    return found.select(key, score.alias(f"rouge{order}"))


def l(pairs: DataFrame, key: str = "id") -> DataFrame:  # noqa: E743
    """(id, rougeL); the subsequence runs in Arrow batches, a narrow pass over the pairs."""
    left, right = tokens(F.col("prediction")), tokens(F.col("reference"))
    measured = pairs.select(
        key,
        common_length(F.array_join(left, "\n"), F.array_join(right, "\n")).alias("_l"),
        F.size(left).alias("_p"),
        F.size(right).alias("_r"),
    )
    return measured.select(key, f_score(F.col("_l"), F.col("_p"), F.col("_r")).alias("rougeL"))


def score(predictions: DataFrame, references: DataFrame, key: str = "id") -> DataFrame:
    """Per sample: status and the three scores.

    ``predictions`` has (id, prediction, outcome, error) with outcome ok, too_long or failed. A
    blank prediction counts as a failure.
    """
    pairs = predictions.join(references.select(key, "reference"), key)
    status = (
        F.when(F.col("outcome") == "too_long", "pipeline_contract_mismatch")
        .when((F.col("outcome") != "ok") | is_blank(F.col("prediction")), "failed")
        .otherwise("evaluated")
    )
    judged = pairs.withColumn("status", status)
    good = judged.where("status = 'evaluated'").select(key, "prediction", "reference")
    found = overlap(good, ORDERS, key)
    counts = found.select(
        key,
        *[
            f_score(F.col(f"overlap{k}"), F.col(f"predicted{k}"), F.col(f"expected{k}")).alias(f"rouge{k}")
            for k in ORDERS
        ],
    )
    # Fixed value: the error text of records without a summary.
    error = F.when(
        (F.col("status") == "failed") & (F.col("outcome") == "ok"),
        F.lit("RuntimeError: pipeline_returned_empty_summary"),
    ).otherwise(F.col("error"))
    return (
        judged.join(counts, key, "left")
        .join(l(good, key), key, "left")
        .select(key, "status", "rouge1", "rouge2", "rougeL", error.alias("error"))
    )
