"""Registered queries in DataFrame functions only: mixing, fingerprints, quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm import merkle, mixing, quality
from articleflow.llm.common import staged, table
from articleflow.llm.registry import query


def _mix_sql() -> str:
    """The same raking with its rounds written out."""
    lang = mixing.TARGETS["lang"]
    named = ", ".join(f"'{k}'" for k in lang)
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in lang.items())
    left = max(0.0, 1.0 - sum(lang.values()))
    parts = [
        """docs AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  CASE WHEN contains(t, 'password') OR contains(t, 'secret') OR contains(t, 'AKIA') THEN 'credentials'
    WHEN contains(t, 'icense') OR contains(t, 'opyright') THEN 'licence'
    WHEN contains(t, '@') THEN 'contact' WHEN contains(t, ' | ') THEN 'tabular' ELSE 'prose' END AS topic,
  len(list_filter(string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '')) + 1 AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM docs GROUP BY ALL)",
        f"raw_source AS (SELECT source, pow(sum(n), {mixing.TARGETS['source']}) AS r FROM cells GROUP BY source)",
        f"raw_topic AS (SELECT topic, pow(sum(n), {mixing.TARGETS['topic']}) AS r FROM cells GROUP BY topic)",
        f"""raw_lang AS (SELECT lang, CASE lang {case} ELSE {left} * sum(n) /
  (SELECT coalesce(sum(n), 1) FROM cells WHERE lang NOT IN ({named})) END AS r FROM cells GROUP BY lang)""",
        *(f"s_{m} AS (SELECT {m}, r / (SELECT sum(r) FROM raw_{m}) AS share FROM raw_{m})" for m in mixing.MARGINS),
        "w0 AS MATERIALIZED (SELECT *, n AS weight FROM cells)",
    ]
    for i in range(mixing.ROUNDS * 3):
        m = mixing.MARGINS[i % 3]
        parts.append(
            f"w{i + 1} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.n, w.weight * s.share / t.total AS weight "
            f"FROM w{i} w JOIN s_{m} s USING ({m}) JOIN (SELECT {m}, sum(weight) AS total FROM w{i} GROUP BY {m}) t USING ({m}))"
        )
    last = f"w{mixing.ROUNDS * 3}"
    parts += [
        f"ordered AS (SELECT *, row_number() OVER (ORDER BY weight / n DESC, source, lang, topic) AS k, sum(n) OVER (ORDER BY weight / n DESC, source, lang, topic) - n AS full_n, "
        f"sum(weight) OVER (ORDER BY weight / n, source DESC, lang DESC, topic DESC) AS open_weight FROM {last})",
        # the scale is the first at which the next cell in order is not full any more
        f"factor AS (SELECT arg_min(f, k) FILTER (WHERE f * weight / n < 1) AS f FROM (SELECT *, "
        f"({mixing.BUDGET} * (SELECT sum(n) FROM cells) - full_n) / open_weight AS f FROM ordered))",
        f"rated AS (SELECT source, lang, topic, weight, least(1.0, (SELECT f FROM factor) * weight / n) AS probability FROM {last})",
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < probability AS sampled
FROM docs JOIN rated USING (source, lang, topic)"""


@query("op2_mixing", _mix_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


MERKLE_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nexts AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM docs)
SELECT doc_id, length(text) AS n_chars,
  sha256(left(text, length(text) - length(text) // 3) || left(next_text, length(text) // 3)) AS edited_sha256
FROM nexts
"""


def merkle_rows(documents: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and how alike they are."""
    n = F.length("text")
    pairs = merkle.with_next(documents).select(
        "doc_id", n.cast("long").alias("n_chars"), "_tree", "_next_tree",
        F.concat(
            F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 3)).cast("int")),
            F.substring(F.col("next_text"), F.lit(1), F.floor(n / 3).cast("int")),
        ).alias("_edited"),
    )
    edited = pairs.select("*", merkle.tree(F.col("_edited")).alias("_edited_tree"))
    a, b, c = (F.col(x) for x in ("_tree", "_edited_tree", "_next_tree"))
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        merkle.as_text(a).alias("fingerprint"), merkle.as_text(b).alias("edited_fingerprint"),
        merkle.likeness(a, b).alias("near_edited"), merkle.likeness(a, c).alias("near_next"),
        F.size(merkle.changed(a, b)).cast("long").alias("n_changed"),
    )


@query("op5_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(quality.statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    rules = quality.learn(stats, table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & quality.verdict(rules)).alias("kept"),
    )
