"""Sentence vectors: hashed TF-IDF by default, a model through a batch hook, mean pooling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.functions.rouge_text import tokens
from articleflow.session import by_key, staged

DIMENSIONS = 4096
BATCH = 32


def term_of(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """Hash bucket of a token."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def encode(
    sentences: DataFrame,
    key: str = "doc_id",
    dimensions: int = DIMENSIONS,
    token_pattern: str | None = None,
    placed: bool = False,
) -> DataFrame:
    """(doc_id, sent_idx, term, weight) of sentence rows: term count x ln((N+1)/(df+1)).

    Sentences are placed while they are compact (unless rows of a key lie in one task already: ``placed``) and read
    once: their term counts are written down, and each has a row without a term that counts the sentence itself.
    The frequency table has at most ``dimensions`` rows, so it is sent to all tasks.
    """
    found = (
        tokens(F.col("sentence"))
        if token_pattern is None
        else F.regexp_extract_all(F.lower("sentence"), F.lit(token_pattern), F.lit(0))
    )
    rows = sentences.select(key, "sent_idx", "sentence")
    rows = rows if placed else by_key(rows, key, "sent_idx")
    strings = lambda *items: F.array(*items).cast("array<string>")
    with_itself = F.concat(F.coalesce(found, strings()), strings(F.lit(None)))
    counts = staged(
        rows.select(key, "sent_idx", F.explode(with_itself).alias("token"))
        .groupBy(key, "sent_idx", term_of(F.col("token"), dimensions).alias("term"))
        .agg(F.count(F.lit(1)).alias("tf")),
        "terms",
    )
    terms = counts.where("term is not null")
    seen = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = counts.where("term is null").agg(F.sum("tf").alias("n")).scalar()
    return terms.join(F.broadcast(seen), "term").select(
        key, "sent_idx", "term", (F.col("tf") * F.log((total + 1) / (F.col("df") + 1))).alias("weight")
    )


def encode_with_model(
    sentences: DataFrame, make_predict: Callable, output: str = "vector", batch: int = BATCH
) -> DataFrame:
    """One dense vector per sentence row; the model is loaded once per Python worker.

    ``make_predict()`` returns a function from a batch of sentences to a 2-d float array.
    """
    predict = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch
    )
    return sentences.withColumn(output, predict(F.col("sentence")))


def mean_pool(token_vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the token vectors whose ``mask`` is 1, as one array per key.

    Positions are averaged with map-side combine; only one number per position reaches a vector.
    """
    cells = token_vectors.select(*keys, "mask", F.posexplode("vector").alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg(
        (F.sum(F.col("x").cast("double") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1e-8))).alias("x")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda c: c["x"]).alias("vector"))
