"""Summaries of whole article tables: extract, generate, check."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.functions import text
from articleflow.functions.summary_text import normalise_summary
from articleflow.operators import facts, rank, vectors
from articleflow.session import by_key, cut_lineage

# Fixed values.
EMPTY_AFTER_CLEANING = "输入正文清洗后为空，无法生成摘要。"
NO_SENTENCES = "输入正文无法切分出有效句子，无法生成摘要。"
NOTHING_CHOSEN = "Token Budget 未选出任何句子，无法生成摘要。"
EMPTY_SUMMARY = "正式摘要模型输出为空，无法生成摘要。"
FACTS_REJECTED = "摘要硬事实校验未通过，不交付："
# No character becomes more than 18 characters in NFKC, so this bounds the tokens of a text.
NFKC_GROWTH = 18


def extractive(
    articles: DataFrame,
    budget: int = 512,
    char_per_token: float = 2.0,
    enders: str = text.ENDERS,
    script: str = "cjk",
    key: str = "id",
    token_pattern: str | None = None,
) -> DataFrame:
    """(id, outcome, cleaned, selected, error) for articles with (id, content, token_count).

    Outcomes: ok, too_long (judged on the raw article, before any work) or failed. Texts move
    once, to their id's partition, and are cleaned and split once; choices are made there.
    """
    short = articles.where(F.col("token_count") <= budget)
    long = articles.where(~F.coalesce(F.col("token_count") <= budget, F.lit(False)))
    docs = cut_lineage(
        by_key(short.select(key, "content"), key)
        .select(key, text.clean(F.col("content")).alias("cleaned"))
        .withColumn("texts", text.sentence_array(F.col("cleaned"), enders, script))
    )
    rows = docs.select(key, F.posexplode("texts").alias("sent_idx", "sentence")).withColumn(
        "sent_idx", F.col("sent_idx").cast("long")
    )
    weights = vectors.encode(rows, key, token_pattern=token_pattern, placed=True)
    sizes = short.select(key, (F.length("content") * NFKC_GROWTH).alias("cells"))
    counted = docs.withColumn("sentences", F.size("texts").cast("long"))
    scored = rank.score_lists(weights, counted, key, sizes=sizes)
    ranked = F.transform(
        F.arrays_zip("scores", "texts"),
        lambda x, i: F.struct(
            x["scores"].alias("score"), i.cast("long").alias("sent_idx"), x["texts"].alias("sentence")
        ),
    )
    selected = F.array_join(rank.choose(ranked, budget, char_per_token), "")
    error = (
        F.when(F.col("cleaned") == "", EMPTY_AFTER_CLEANING)
        .when(F.col("sentences") == 0, NO_SENTENCES)
        .when(F.col("selected") == "", NOTHING_CHOSEN)
    )
    worked = scored.withColumn("selected", selected).withColumn("error", error).select(
        key,
        F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("outcome"),
        "cleaned",
        F.when(F.col("error").isNull(), F.col("selected")).alias("selected"),
        "error",
    )
    refused = long.select(
        key,
        F.lit("too_long").alias("outcome"),
        F.lit(None).cast("string").alias("cleaned"),
        F.lit(None).cast("string").alias("selected"),
        F.concat(
            F.lit("输入正文过长："), F.col("token_count").cast("string"),
            F.lit(f" token，超过正式模型最大输入 {budget} token。"),
        ).alias("error"),
    )
    return worked.unionByName(refused)


def batch(
    df: DataFrame,
    make_predict: Callable[[], Callable[[Sequence[str]], Sequence[str]]] | None = None,
    model_version: str = "extractive-v1",
    batch_size: int = 32,
    key: str = "id",
) -> DataFrame:
    """Generate summaries for ``extractive`` rows; one failing article never stops a batch.

    ``make_predict`` runs once per task. A failing batch, or one with another number of outputs than texts, is
    retried article by article. Without a
    model the selected text is the summary and the plan stays in the JVM.
    """
    if make_predict is None:
        return df.select(
            key, "outcome", "cleaned", F.col("selected").alias("summary"),
            F.lit(0).cast("long").alias("generation_time_ms"),
            F.when(F.col("outcome") == "ok", model_version).alias("model_version"), "error",
        )

    def attempt(predict, texts: list[str]) -> list[tuple[str | None, str | None, int]]:
        began = time.perf_counter_ns()
        try:
            made = list(predict(texts))
            if len(made) != len(texts):
                raise ValueError(f"{len(made)} outputs for {len(texts)} texts")
            spent = (time.perf_counter_ns() - began) // 1_000_000 // max(1, len(texts))
            return [(m, None, spent) for m in made]
        except Exception as problem:  # a row's failure is its outcome
            if len(texts) > 1:
                return [attempt(predict, [t])[0] for t in texts]
            return [(None, f"{type(problem).__name__}: {problem}", 0)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for frame in frames:
            outcome, errors = list(frame["outcome"]), list(frame["error"])
            summaries: list[str | None] = [None] * len(frame)
            versions: list[str | None] = [None] * len(frame)
            times = [0] * len(frame)
            todo = [row for row, state in enumerate(outcome) if state == "ok"]
            texts = list(frame["selected"])
            made: list[tuple[str | None, str | None, int]] = []
            for at in range(0, len(todo), batch_size):
                made += attempt(predict, [texts[row] for row in todo[at : at + batch_size]])
            for row, (summary, error, spent) in zip(todo, made, strict=True):
                times[row] = spent
                if error is not None or not summary:
                    outcome[row], errors[row] = "failed", error or EMPTY_SUMMARY
                else:
                    summaries[row], versions[row] = summary, model_version
            out = frame.assign(
                outcome=outcome, summary=summaries, generation_time_ms=times, model_version=versions, error=errors
            )
            yield out[[key, "outcome", "cleaned", "summary", "generation_time_ms", "model_version", "error"]]

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "outcome", "cleaned", "selected", "error").mapInPandas(
        run,
        f"{key} {kind}, outcome string, cleaned string, summary string, generation_time_ms bigint, "
        "model_version string, error string",
    )


def gate(df: DataFrame) -> DataFrame:
    """Normalise summaries and fail those with facts the cleaned source does not hold."""
    tidy = df.withColumn("summary", F.when(F.col("outcome") == "ok", normalise_summary(F.col("summary"))))
    found = F.array_join(facts.violations(F.col("summary"), F.col("cleaned")), "；")
    judged = tidy.withColumn("_found", F.when(F.col("outcome") == "ok", found))
    broken = F.coalesce(F.col("_found") != "", F.lit(False))
    return judged.withColumns(
        {
            "outcome": F.when(broken, "failed").otherwise(F.col("outcome")),
            "error": F.when(broken, F.concat(F.lit(FACTS_REJECTED), "_found")).otherwise(F.col("error")),
            "summary": F.when(~broken, F.col("summary")),
            "model_version": F.when(~broken, F.col("model_version")),
        }
    ).drop("_found")
