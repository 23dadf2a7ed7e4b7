"""Corpus audit, normalisation, duplicates, overlaps and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions.text import SPACE, is_blank, sha256, strip
from articleflow.operators.stats import distribution

CORE_FIELDS = ["article", "summary", "id", "label"]
OPTIONAL_FIELDS = ["adequacy", "deducibility"]


def json_text(col: Column) -> Column:
    """Compact JSON text of one value; null stays null."""
    wrapped = F.to_json(F.struct(col.alias("v")))
    return F.when(col.isNotNull(), F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def identity(item_id: Column, article: Column, reference: Column) -> Column:
    """The JSON text of the id, or a content fingerprint where there is none."""
    content = F.to_json(F.struct(article.alias("article"), reference.alias("reference")))
    return F.coalesce(json_text(item_id), F.concat(F.lit("content:"), sha256(content)))


def record_key(df: DataFrame, fields: Sequence[str]) -> Column:
    """SHA-256 of the record as compact JSON with sorted keys."""
    return sha256(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}))


def normalise(scanned: DataFrame, split: str, file: str = "source_file") -> DataFrame:
    """Normalised records of a JSON-lines scan, one out per line in, with the line's ``status``.

    Lines that are no record, and records whose article is no list of strings (``not_list``), keep their row
    and have nulls. ``line_accounts`` counts them; ``jsonl.strict`` aborts on them instead.
    """
    listed = F.try_variant_get("record", "$.article", "array<string>").isNotNull()
    status = F.when((F.col("status") == "ok") & ~listed, "not_list").otherwise(F.col("status"))
    good = scanned.withColumn("status", status).withColumn("record", F.when(F.col("status") == "ok", F.col("record")))
    sentences = F.variant_get("record", "$.article", "array<string>")
    optional = [F.try_variant_get("record", f"$.{f}", "string").alias(f) for f in OPTIONAL_FIELDS]
    return good.select(
        F.to_json(F.variant_get("record", "$.id", "variant")).alias("id"),
        F.array_join(sentences, " ").alias("article"),
        sentences.alias("article_sentences"),
        F.variant_get("record", "$.summary", "string").alias("summary"),
        F.to_json(F.variant_get("record", "$.label", "variant")).alias("label"),
        F.lit(split).alias("source_split"),
        F.col(file).alias("source_file"),
        "status",
        *optional,
    )


def line_accounts(normalised: DataFrame) -> DataFrame:
    """Per file: lines read, records made, and lines that are none; the first is the sum of the others."""
    made = F.col("status") == "ok"
    return normalised.groupBy("source_split", "source_file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(made).alias("records"), F.count_if(~made).alias("refused")
    )


def value_type(col: Column) -> Column:
    """Type of a variant value, by the names JSON readers use for it."""
    kind = F.schema_of_variant(col)
    return (
        F.when(kind.startswith("OBJECT"), "dict")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "VOID", "NoneType")
        .when(kind.rlike(r"^(?:TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$"), "int")
        .otherwise("float")
    )


def inspect(scanned: DataFrame, by: str) -> DataFrame:
    """One audit row per split over classified lines (status, record)."""
    ok = F.col("status") == "ok"
    field = lambda name: F.try_variant_get("record", f"$.{name}", "variant")
    kinds = {name: value_type(field(name)) for name in ("article", "summary")}
    sentences = F.when(kinds["article"] == "list", F.try_variant_get("record", "$.article", "array<variant>"))
    texts = F.filter(
        F.transform(sentences, lambda s: F.when(F.schema_of_variant(s) == "STRING", F.try_variant_get(s, "$", "string"))),
        lambda s: s.isNotNull(),
    )
    joined = F.array_join(texts, "")
    summary = F.when(kinds["summary"] == "str", F.try_variant_get("record", "$.summary", "string"))
    prepared = scanned.select(
        by,
        "status",
        *[(ok & field(name).isNull()).alias(f"no_{name}") for name in CORE_FIELDS],
        (ok & sentences.isNull()).alias("bad_article"),
        (ok & summary.isNull()).alias("bad_summary"),
        F.when(ok & sentences.isNotNull(), joined).alias("text"),
        F.when(ok, F.size(sentences) - F.size(F.filter(texts, lambda s: strip(s) != ""))).alias("hollow"),
        F.when(ok, summary).alias("summary"),
    )
    return prepared.groupBy(by).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(ok).alias("valid_lines"),
        F.count_if(F.col("status") == "empty_line").alias("empty_lines"),
        F.count_if(F.col("status") == "json_decode").alias("parse_errors"),
        F.count_if(F.col("status") == "not_dict").alias("non_dict"),
        *[F.count_if(F.col(f"no_{name}")).alias(f"missing_{name}") for name in CORE_FIELDS],
        F.count_if("bad_article").alias("article_not_list"),
        F.count_if("bad_summary").alias("summary_not_str"),
        F.count_if(F.col("text").isNotNull() & is_blank(F.col("text"))).alias("article_empty"),
        F.count_if(F.col("summary").isNotNull() & is_blank(F.col("summary"))).alias("summary_empty"),
        F.coalesce(F.sum("hollow"), F.lit(0)).alias("article_empty_sentences"),
        F.coalesce(F.max(F.length("text")), F.lit(0)).cast("long").alias("article_chars_max"),
        F.coalesce(F.max(F.length("summary")), F.lit(0)).cast("long").alias("summary_chars_max"),
    )


def field_types(scanned: DataFrame, by: str) -> DataFrame:
    """(split, field, type, n): how often each field occurs with each type."""
    spark = scanned.sparkSession
    fields = scanned.where("status = 'ok'").lateralJoin(
        spark.tvf.variant_explode(F.col("record").outer())
    )
    return fields.groupBy(by, F.col("key").alias("field"), value_type(F.col("value")).alias("type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def schema_profile(scanned: DataFrame, by: str) -> DataFrame:
    """(split, field, types): the types seen per field; the set is as small as JSON's type list."""
    return field_types(scanned, by).groupBy(by, "field").agg(
        F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types")
    )


def duplicates(df: DataFrame, by: str, identity_col: str, article: str, summary: str) -> DataFrame:
    """Rows minus distinct values for ids, article hashes and summary hashes, per split."""
    hashed = df.select(
        by,
        F.col(identity_col).cast("string").alias("duplicate_ids"),
        sha256(F.col(article)).alias("duplicate_articles"),
        sha256(F.col(summary)).alias("duplicate_summaries"),
    )
    kinds = ["duplicate_ids", "duplicate_articles", "duplicate_summaries"]
    per_value = hashed.unpivot([by], kinds, "kind", "value").groupBy(by, "kind", "value").agg(
        (F.count(F.lit(1)) - 1).alias("extra")
    )
    return per_value.groupBy(by).agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("extra")).otherwise(0)).alias(k) for k in kinds]
    )


def length_stats(df: DataFrame, by: str, sentences: str, article: str, summary: str) -> DataFrame:
    """Distributions of sentence, character and space-token counts per split."""
    words = lambda c: F.when(strip(F.col(c)) == "", 0).otherwise(
        F.size(F.split(strip(F.col(c)), f"{SPACE}+"))
    )
    lengths = df.select(
        by,
        F.size(sentences).alias("article_sentences"),
        F.length(article).alias("article_chars"),
        F.length(summary).alias("summary_chars"),
        words(article).alias("article_space_tokens"),
        words(summary).alias("summary_space_tokens"),
    )
    return distribution(lengths, [c for c in lengths.columns if c != by], [by])


def _distinct(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def overlap_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Ids in both; copies are removed before the join, so none of them makes a hot key."""
    return _distinct(a, [key]).join(_distinct(b, [key]), key, "left_semi")


def overlap_pairs(a: DataFrame, b: DataFrame, article: str, summary: str) -> DataFrame:
    """(article hash, summary hash) pairs in both."""
    hashed = lambda df: df.select(
        sha256(F.col(article)).alias("article_sha"), sha256(F.col(summary)).alias("summary_sha")
    )
    keys = ["article_sha", "summary_sha"]
    return _distinct(hashed(a), keys).join(_distinct(hashed(b), keys), keys, "left_semi")


def except_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Ids only in the first."""
    return _distinct(a, [key]).join(_distinct(b, [key]), key, "left_anti")


def compare(a: DataFrame, b: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """Same ids, ids on one side only, and same ids with other content."""
    shape = lambda df, n: df.groupBy(key).agg(
        F.max_by(F.struct(*content), F.struct(*content)).alias(n)
    )
    both = shape(a, "_a").join(shape(b, "_b"), key, "full_outer")
    left, right = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(
        F.count_if(left & right).alias("same_id_count"),
        F.count_if(left & ~right).alias("left_only"),
        F.count_if(~left & right).alias("right_only"),
        F.count_if(left & right & (F.col("_a") != F.col("_b"))).alias("content_mismatches"),
    )


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(rows, digest) of a whole table, whatever its order: sum of 48-bit row digests."""
    row = sha256(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    number = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(number).cast("string").alias("digest"))


def _rows_digest(row: Column) -> Column:
    """Digest of rows of one place: a lone row's own; of several, their number and the sums of its eight parts."""
    parts = [
        F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)
    ]
    several = sha256(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *parts))
    return F.when(F.count(F.lit(1)) == 1, F.max(row)).otherwise(several)


def sample_fingerprint(
    df: DataFrame, columns: Sequence[str], order: str, width: int = 4096, levels: int = 3
) -> DataFrame:
    """Ordered digest of a table of any size: a tree of SHA-256 over ranges of ``order``, a whole number.

    Rows of equal order become one digest by sums, in tasks, so a repeated number (or null, which comes first) is
    never gathered. Each level joins the digests of ``width`` numbers, one per line. ``levels`` is the least
    depth; a wider range gets a deeper tree, so that no group, the last one included, has more than ``width``
    numbers (and the one for null). The result depends on the rows, ``width`` and ``levels`` alone. An empty table has no row.
    """
    row = sha256(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    at = F.col(order).cast("long")
    low, high = df.agg(F.min(at), F.max(at)).first()
    depth, low, high = 1, low or 0, high or 0
    while depth < levels or high - low >= width:
        depth, low, high = depth + 1, low // width, high // width
    step = df.select(at.alias("at"), row.alias("row")).groupBy("at").agg(_rows_digest(F.col("row")).alias("row"))
    below = F.expr(f"at div {width} - if(at % {width} < 0, 1, 0)")
    for level in range(depth):
        up = F.lit(0).cast("long") if level == depth - 1 else below
        lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"])
        step = step.withColumn("up", up).groupBy("up").agg(sha256(F.array_join(lines, "\n")).alias("row")).withColumnRenamed("up", "at")
    return step.select(F.col("row").alias("digest"))
