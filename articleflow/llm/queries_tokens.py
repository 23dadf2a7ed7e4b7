"""Registered queries: packing, token files, token counts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm import counts, packing, simple8b
from articleflow.llm.common import table
from articleflow.llm.registry import query
from articleflow.session import fresh_path


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are: the installed package, or the folder that TOKENIZER_DIR names."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost"
    )


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    simple8b.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), blanks=False, end_id=2)
    return simple8b.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
