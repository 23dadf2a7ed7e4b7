"""Registered queries: toxicity, URL filters, secret scans, near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm import secrets, simhash, toxicity, urls
from articleflow.llm.common import table
from articleflow.llm.registry import query

#: Rules and listed domains of the URL query.
RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)
LISTED = ("casino-win.example.org", "adult-x.example.net", "spam-farm.example.org", "spam-farm.example.com", "casino-win.example.net")

URLS_SQL = f"""
WITH cut AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS raw,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut
), rules(verdict, host, path) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}),
listed(name) AS (VALUES {", ".join(f"('{n}')" for n in LISTED)}),
judged AS (
  SELECT p.page_id, p.host, p.path,
    (SELECT arg_max(r.host || r.path || ' ' || r.verdict, length(r.host || r.path)) FROM rules r
     WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best,
    EXISTS (SELECT 1 FROM listed l WHERE p.host = l.name OR ends_with(p.host, '.' || l.name)) AS listed
  FROM parts p
)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule,
  coalesce(split_part(best, ' ', 2), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM judged
"""


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model)


@query("op3_url_filter", URLS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES, LISTED)


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(r.kind) for r in secrets.default_scanner().rules))
    found = secrets.scan(table(spark, sf_dir, "documents"))
    spans = F.arrays_zip("kinds", "starts", "ends")
    label = lambda s: F.concat_ws(":", F.get(names, s["kinds"]), s["starts"], s["ends"])
    base = F.filter(spans, lambda s: s["kinds"] < 3)
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, label), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, label), ",").alias("spans"),
    )


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
