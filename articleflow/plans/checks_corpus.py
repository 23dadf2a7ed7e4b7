"""Corpus audits, lengths, samples and manifests over the given tables."""

from pyspark.sql import functions as F

from articleflow.functions.text import sha256
from articleflow.operators import corpus as C
from articleflow.operators import lengths, manifest, sample, stats
from articleflow.plans.catalogue import query
from articleflow.plans.mapping import CORPUS_SQL, corpus, rounded
from articleflow.session import fresh_path
from articleflow.sources import jsonl, sinks
from articleflow.sources.tables import read

LINES_SQL = """
lines AS (SELECT event_id, event_type AS split, CASE WHEN value < 20 THEN substr(props, 1, length(props) - 1)
  WHEN value < 30 THEN '  ' WHEN value < 40 THEN '[' || props || ']' WHEN value < 50 THEN '7' ELSE props END AS raw FROM events),
classed AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'empty_line' WHEN NOT json_valid(raw) THEN 'json_decode'
  WHEN json_type(raw) = 'OBJECT' THEN 'ok' ELSE 'not_dict' END AS status FROM lines)"""


def _lines(spark, d):
    value, props = F.col("value"), F.col("props")
    raw = (
        F.when(value < 20, F.substring(props, F.lit(1), F.length(props) - 1))
        .when(value < 30, "  ")
        .when(value < 40, F.concat(F.lit("["), props, F.lit("]")))
        .when(value < 50, "7")
        .otherwise(props)
    )
    return read(spark, d, "events").select("event_id", F.col("event_type").alias("split"), raw.alias("raw"))


@query("jsonl_classify", f"WITH {LINES_SQL} SELECT event_id, status FROM classed")
def jsonl_classify(spark, d):
    return jsonl.classify(_lines(spark, d), "raw").select("event_id", "status")


@query(
    "jsonl_scan",
    f"WITH {LINES_SQL} SELECT split, status, count(*) AS n, true AS numbered FROM classed GROUP BY split, status",
)
def jsonl_scan(spark, d):
    """Write the lines as text files, scan them, and check that every file counts 1..n."""
    path = fresh_path(spark, "lines")
    _lines(spark, d).select("split", F.col("raw").alias("value")).write.partitionBy("split").text(path)
    split = F.regexp_extract("source_file", "split=([^/]+)/", 1)
    scanned = jsonl.scan(spark, path).select("source_file", split.alias("split"), "line_no", "status")
    per_file = scanned.groupBy("split", "source_file").agg(
        (F.sum("line_no") == F.count("line_no") * (F.max("line_no") + 1) / 2).alias("numbered")
    )
    good = per_file.groupBy("split").agg(F.bool_and("numbered").alias("numbered"))
    return scanned.groupBy("split", "status").agg(F.count(F.lit(1)).alias("n")).join(good, "split")


@query(
    "jsonl_round_trip",
    """SELECT conv_id, turn, role, sha256(text) AS text_hash, 'ok' AS status FROM conversations""",
)
def jsonl_round_trip(spark, d):
    path = fresh_path(spark, "conversations")
    sinks.jsonl(read(spark, d, "conversations"), path)
    back = jsonl.scan(spark, path)
    value = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind)
    return back.select(
        value("conv_id", "bigint").alias("conv_id"), value("turn", "bigint").alias("turn"),
        value("role", "string").alias("role"), sha256(value("text", "string")).alias("text_hash"), "status",
    )


RECORDS_SQL = """
rec AS (SELECT c.doc_id AS id, CASE WHEN length(source) = 4 THEN 'train' ELSE 'test' END AS split, text,
  string_split(text, chr(10)) AS sentences, quality, n_chars FROM documents c LEFT JOIN labels USING (doc_id))"""


def _records(spark, d):
    """Documents as raw corpus lines: article list, summary, id, label; some fields missing or mistyped."""
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    article = F.split("text", "\n")
    full = F.to_json(
        F.struct(
            article.alias("article"), F.substring_index("text", "\n", 1).alias("summary"),
            F.col("doc_id").alias("id"), F.when(F.col("quality").isNotNull(), F.array("quality")).alias("label"),
        )
    )
    odd = F.to_json(F.struct(F.col("text").alias("article"), F.col("n_chars").alias("summary"), F.col("lang").alias("id")))
    return docs.select(
        F.when(F.length("source") == 4, "train").otherwise("test").alias("split"),
        F.when(F.col("lang") == "es", odd).otherwise(full).alias("raw"),
    )


@query(
    "corpus_audit",
    """WITH rec AS (SELECT doc_id, CASE WHEN length(source) = 4 THEN 'train' ELSE 'test' END AS split, lang = 'es' AS odd, text, n_chars,
      quality, string_split(text, chr(10)) AS s FROM documents LEFT JOIN labels USING (doc_id))
    SELECT split, count(*) AS line_count, count(*) AS valid_lines, 0::BIGINT AS empty_lines, 0::BIGINT AS parse_errors,
    0::BIGINT AS non_dict, 0::BIGINT AS missing_article, 0::BIGINT AS missing_summary, 0::BIGINT AS missing_id,
    count(*) FILTER (odd OR quality IS NULL) AS missing_label, count(*) FILTER (odd) AS article_not_list,
    count(*) FILTER (odd) AS summary_not_str, count(*) FILTER (NOT odd AND regexp_full_match(text, '\\s*')) AS article_empty,
    count(*) FILTER (NOT odd AND trim(s[1]) = '') AS summary_empty,
    coalesce(sum(len(list_filter(s, lambda x: trim(x) = ''))) FILTER (NOT odd), 0)::BIGINT AS article_empty_sentences,
    coalesce(max(length(replace(text, chr(10), ''))) FILTER (NOT odd), 0) AS article_chars_max,
    coalesce(max(length(s[1])) FILTER (NOT odd), 0) AS summary_chars_max FROM rec GROUP BY split""",
)
def corpus_audit(spark, d):
    return C.inspect(jsonl.classify(_records(spark, d), "raw"), "split")


TYPES_SQL = """WITH rec AS (SELECT CASE WHEN length(source) = 4 THEN 'train' ELSE 'test' END AS split, lang = 'es' AS odd, quality
  FROM documents LEFT JOIN labels USING (doc_id)), f AS (
  SELECT split, 'article' AS field, CASE WHEN odd THEN 'str' ELSE 'list' END AS type FROM rec UNION ALL
  SELECT split, 'summary', CASE WHEN odd THEN 'int' ELSE 'str' END FROM rec UNION ALL
  SELECT split, 'id', CASE WHEN odd THEN 'str' ELSE 'int' END FROM rec UNION ALL
  SELECT split, 'label', 'list' FROM rec WHERE NOT odd AND quality IS NOT NULL)"""


@query("field_types", TYPES_SQL + " SELECT split, field, type, count(*) AS n FROM f GROUP BY ALL")
def field_types(spark, d):
    return C.field_types(jsonl.classify(_records(spark, d), "raw"), "split")


@query(
    "schema_profile",
    TYPES_SQL + " SELECT split, field, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM f GROUP BY ALL",
)
def schema_profile(spark, d):
    return C.schema_profile(jsonl.classify(_records(spark, d), "raw"), "split")


@query(
    "corpus_normalise",
    """SELECT doc_id::VARCHAR AS id, sha256(replace(text, chr(10), ' ')) AS article_hash,
    len(string_split(text, chr(10))) AS sentences, sha256(split_part(text, chr(10), 1)) AS summary_hash,
    CASE WHEN quality IS NULL THEN '' ELSE '[' || quality || ']' END AS label, 'ok' AS status
    FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> 'es'
    UNION ALL SELECT NULL, NULL, NULL, NULL, '', 'not_list' FROM documents WHERE lang = 'es'""",
)
def corpus_normalise(spark, d):
    lines = jsonl.classify(_records(spark, d).withColumn("source_file", F.lit("x")), "raw")
    return C.normalise(lines, "all").select(
        "id", sha256(F.col("article")).alias("article_hash"),
        F.when(F.col("article_sentences").isNotNull(), F.size("article_sentences")).cast("long").alias("sentences"),
        sha256(F.col("summary")).alias("summary_hash"), F.coalesce("label", F.lit("")).alias("label"), "status",
    )


@query(
    "corpus_line_accounts",
    """SELECT 'all' AS source_split, 'x' AS source_file, count(*) AS lines, count(*) FILTER (lang <> 'es') AS records,
    count(*) FILTER (lang = 'es') AS refused FROM documents""",
)
def corpus_line_accounts(spark, d):
    lines = jsonl.classify(_records(spark, d).withColumn("source_file", F.lit("x")), "raw")
    return C.line_accounts(C.normalise(lines, "all"))


@query(
    "identities",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN doc_id::VARCHAR ELSE 'content:' || sha256(to_json({'article': source, 'reference': lang})) END
    AS identity, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS record_key FROM documents""",
)
def identities(spark, d):
    item = F.when(F.col("lang") == "en", F.col("doc_id"))
    docs = read(spark, d, "documents")
    return docs.select(
        "doc_id", C.identity(item, F.col("source"), F.col("lang")).alias("identity"),
        C.record_key(docs, ["source", "lang"]).alias("record_key"),
    )


@query(
    "duplicates",
    f"""WITH {CORPUS_SQL} SELECT split, count(*) - count(DISTINCT id) AS duplicate_ids, count(*) - count(DISTINCT article) AS duplicate_articles,
    count(*) - count(DISTINCT summary) AS duplicate_summaries FROM corpus GROUP BY split""",
)
def duplicates(spark, d):
    return C.duplicates(corpus(spark, d), "split", "id", "article", "summary")


DIST = """count(v) AS count, min(v)::DOUBLE AS min, round(avg(v), 6) AS mean, round(median(v), 6) AS median,
  round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, max(v)::DOUBLE AS max"""
DIST_COLS = ["min", "mean", "median", "p90", "p95", "p99", "max"]
EXTRA = "round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75"


@query(
    "length_stats",
    f"""WITH {CORPUS_SQL}, m AS (SELECT split, len(sentences)::DOUBLE AS article_sentences, length(article)::DOUBLE AS article_chars,
      length(summary)::DOUBLE AS summary_chars,
      (CASE WHEN regexp_full_match(article, '\\s*') THEN 0 ELSE len(regexp_split_to_array(regexp_replace(article, '^\\s+|\\s+$', '', 'g'), '\\s+')) END)::DOUBLE AS article_space_tokens,
      (CASE WHEN regexp_full_match(summary, '\\s*') THEN 0 ELSE len(regexp_split_to_array(regexp_replace(summary, '^\\s+|\\s+$', '', 'g'), '\\s+')) END)::DOUBLE AS summary_space_tokens
      FROM corpus), u AS (UNPIVOT m ON COLUMNS(* EXCLUDE split) INTO NAME metric VALUE v)
    SELECT split, metric, {DIST} FROM u GROUP BY split, metric""",
)
def length_stats(spark, d):
    return rounded(C.length_stats(corpus(spark, d), "split", "sentences", "article", "summary"), DIST_COLS)


@query(
    "distribution_prices",
    f"""WITH m AS (SELECT l_returnflag, l_extendedprice, l_quantity, l_discount FROM lineitem),
    u AS (UNPIVOT m ON COLUMNS(* EXCLUDE l_returnflag) INTO NAME metric VALUE v)
    SELECT l_returnflag, metric, {DIST}, {EXTRA} FROM u GROUP BY ALL""",
)
def distribution_prices(spark, d):
    found = stats.distribution(
        read(spark, d, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"], ["l_returnflag"], True
    )
    return rounded(found, [*DIST_COLS, "p50", "p75"])


@query("distribution_whole", f"SELECT 'value' AS metric, {DIST} FROM (SELECT value AS v FROM events)")
def distribution_whole(spark, d):
    return rounded(stats.distribution(read(spark, d, "events"), ["value"]), DIST_COLS)


@query(
    "length_domains",
    f"""WITH {CORPUS_SQL} SELECT split, count(*) AS rows, count(*) FILTER (token_count < 512) AS lt512_count,
    count(*) FILTER (token_count = 512) AS eq512_count, count(*) FILTER (token_count > 512) AS gt512_count,
    round(count(*) FILTER (token_count < 512) / count(*), 6) AS lt512_ratio, round(count(*) FILTER (token_count = 512) / count(*), 6) AS eq512_ratio,
    round(count(*) FILTER (token_count > 512) / count(*), 6) AS gt512_ratio FROM corpus GROUP BY split""",
)
def length_domains(spark, d):
    return rounded(
        lengths.domain_counts(corpus(spark, d), "split"), ["lt512_ratio", "eq512_ratio", "gt512_ratio"]
    )


@query(
    "length_domain_stats",
    f"""WITH {CORPUS_SQL}, s AS (SELECT split, 'all' AS scope, token_count, length(summary) AS summary_chars FROM corpus
      UNION ALL SELECT split, 'lt512', token_count, length(summary) FROM corpus WHERE token_count < 512),
    m AS (SELECT split, scope, token_count::DOUBLE AS token_count, summary_chars::DOUBLE AS summary_chars FROM s),
    u AS (UNPIVOT m ON token_count, summary_chars INTO NAME metric VALUE v)
    SELECT split, scope, metric, {DIST}, {EXTRA} FROM u GROUP BY ALL""",
)
def length_domain_stats(spark, d):
    rows = corpus(spark, d).withColumn("summary_chars", F.length("summary"))
    found = lengths.domain_stats(rows, "split", ["token_count", "summary_chars"])
    return rounded(found, [*DIST_COLS, "p50", "p75"])


@query(
    "eligibility",
    f"""WITH {CORPUS_SQL} SELECT count(*) AS full_count, count(*) FILTER (token_count <= 512) AS eligible_count,
    count(*) FILTER (token_count > 512) AS excluded_count, round(count(*) FILTER (token_count <= 512) / count(*), 6) AS eligible_ratio FROM corpus""",
)
def eligibility(spark, d):
    return rounded(lengths.eligibility(corpus(spark, d)), ["eligible_ratio"])


@query(
    "eligible_rows",
    f"""WITH {CORPUS_SQL} SELECT id, token_count, CASE WHEN token_count < 512 THEN 'lt512' ELSE 'eq512' END AS domain FROM corpus WHERE token_count <= 512""",
)
def eligible_rows(spark, d):
    rows = lengths.eligible(corpus(spark, d))
    return rows.select("id", "token_count", lengths.domain(F.col("token_count")).alias("domain"))


@query(
    "fingerprint",
    """SELECT lang, count(*) AS rows, sum(('0x' || substr(sha256('{"doc_id":' || doc_id || ',"source":"' || source || '","lang":"' || lang || '"}'), 1, 12))::BIGINT)::VARCHAR
    AS digest FROM documents GROUP BY lang""",
)
def fingerprint(spark, d):
    return C.fingerprint(read(spark, d, "documents"), ["doc_id", "source", "lang"], ["lang"])


@query(
    "sample_fingerprint",
    """WITH rows AS (SELECT doc_id AS p, sha256('{"doc_id":' || doc_id || ',"source":"' || source || '"}') AS h FROM documents),
    one AS (SELECT p // 4096 AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h FROM rows GROUP BY p // 4096),
    two AS (SELECT p // 4096 AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h FROM one GROUP BY p // 4096)
    SELECT sha256(string_agg(h, chr(10) ORDER BY p)) AS digest FROM two""",
)
def sample_fingerprint(spark, d):
    return C.sample_fingerprint(read(spark, d, "documents"), ["doc_id", "source"], "doc_id")


@query(
    "overlap_ids",
    f"WITH {CORPUS_SQL} SELECT id FROM corpus WHERE split = 'train' INTERSECT SELECT doc_id FROM labels",
)
def overlap_ids(spark, d):
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return C.overlap_ids(corpus(spark, d).where("split = 'train'"), labels)


@query(
    "overlap_pairs",
    f"""WITH {CORPUS_SQL} SELECT sha256(article) AS article_sha, sha256(summary) AS summary_sha FROM corpus WHERE split = 'train'
    INTERSECT SELECT sha256(article), sha256(summary) FROM corpus WHERE split = 'test'""",
)
def overlap_pairs(spark, d):
    rows = corpus(spark, d)
    return C.overlap_pairs(rows.where("split = 'train'"), rows.where("split = 'test'"), "article", "summary")


@query(
    "except_ids",
    f"""WITH {CORPUS_SQL} SELECT 'corpus_only' AS side, id FROM (SELECT id FROM corpus EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'labels_only', id FROM (SELECT doc_id AS id FROM labels EXCEPT SELECT id FROM corpus WHERE split = 'train')""",
)
def except_ids(spark, d):
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("id"))
    rows = corpus(spark, d)
    mark = lambda df, side: df.select(F.lit(side).alias("side"), "id")
    return mark(C.except_ids(rows, labels), "corpus_only").unionByName(
        mark(C.except_ids(labels, rows.where("split = 'train'")), "labels_only")
    )


@query(
    "corpus_compare",
    f"""WITH {CORPUS_SQL}, a AS (SELECT id, sha256(article) AS h FROM corpus WHERE split = 'train'),
    b AS (SELECT doc_id AS id, sha256(CASE WHEN quality = 1 THEN text ELSE upper(text) END) AS h FROM labels JOIN documents USING (doc_id))
    SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS same_id_count, count(*) FILTER (b.id IS NULL) AS left_only,
    count(*) FILTER (a.id IS NULL) AS right_only, count(*) FILTER (a.h <> b.h) AS content_mismatches FROM a FULL JOIN b ON a.id = b.id""",
)
def corpus_compare(spark, d):
    rows = corpus(spark, d)
    a = rows.where("split = 'train'").select("id", sha256(F.col("article")).alias("h"))
    text = F.when(F.col("quality") == 1, F.col("article")).otherwise(F.upper("article"))
    labelled = rows.join(read(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id")
    return C.compare(a, labelled.select("id", sha256(text).alias("h")), "id", ["h"])


def _indexed(spark, d):
    return corpus(spark, d).select(
        F.col("id").alias("source_index"), F.concat(F.lit("d-"), F.col("id")).alias("id"), "token_count"
    )


def _entries(spark, d):
    """A manifest with some wrong ids, lengths and indexes."""
    good = manifest.build(_indexed(spark, d))
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("source_index"), "quality", "toxic")
    j = good.join(labels, "source_index", "left")
    return j.select(
        F.when(F.col("toxic") == 1, F.col("source_index") + 10_000_000).otherwise(F.col("source_index")).alias("source_index"),
        F.when(F.col("quality") == 0, F.lit("d-0")).otherwise(F.col("id")).alias("id"),
        F.when(F.col("source_index") % 100 == 1, F.col("token_count") + 1).otherwise(F.col("token_count")).alias("token_count"),
    )


ENTRIES_SQL = CORPUS_SQL + """,
entries AS (SELECT CASE WHEN toxic = 1 THEN id + 10000000 ELSE id END AS source_index, CASE WHEN quality = 0 THEN 'd-0' ELSE 'd-' || id END AS id,
  CASE WHEN id % 100 = 1 THEN token_count + 1 ELSE token_count END AS token_count FROM corpus LEFT JOIN labels ON doc_id = id WHERE token_count < 512),
j AS (SELECT e.*, c.id AS cid, c.token_count AS ct FROM entries e LEFT JOIN corpus c ON c.id = e.source_index)"""


@query(
    "manifest_rejoin",
    f"""WITH {ENTRIES_SQL} SELECT count(*) AS manifest_rows, count(*) FILTER (id = 'd-' || cid) AS mapped, count(*) FILTER (cid IS NULL) AS index_missing,
    count(*) FILTER (id <> 'd-' || cid) AS id_mismatch, count(*) FILTER (id = 'd-' || cid AND token_count <> ct) AS length_mismatch FROM j""",
)
def manifest_rejoin(spark, d):
    return manifest.rejoin(_indexed(spark, d), _entries(spark, d))[1]


@query("manifest_rows", f"WITH {ENTRIES_SQL} SELECT source_index, id, ct AS token_count FROM j WHERE id = 'd-' || cid")
def manifest_rows(spark, d):
    rows = manifest.rejoin(_indexed(spark, d), _entries(spark, d))[0]
    return rows.select("source_index", "id", "token_count")


@query(
    "manifest_audit",
    f"""WITH {ENTRIES_SQL} SELECT 'duplicate_id' AS "check", (SELECT count(*) FROM (SELECT id FROM entries GROUP BY id HAVING count(*) > 1)) AS violations
    UNION ALL SELECT 'duplicate_source_index', (SELECT count(*) FROM (SELECT source_index FROM entries GROUP BY 1 HAVING count(*) > 1))""",
)
def manifest_audit(spark, d):
    return manifest.audit(_entries(spark, d))


@query(
    "hash_sample",
    f"""WITH {CORPUS_SQL} SELECT id, token_count FROM corpus WHERE token_count <= 512
    ORDER BY sha256('20260907:' || id), id::VARCHAR, sha256(article || chr(10) || summary) LIMIT 100""",
)
def hash_sample(spark, d):
    rows = lengths.eligible(corpus(spark, d)).withColumnRenamed("summary", "reference")
    return sample.by_hash(rows, 100, "20260907").select("id", "token_count")


@query(
    "sample_manifest",
    f"""WITH {CORPUS_SQL}, s AS (SELECT id FROM corpus WHERE token_count <= 512 ORDER BY sha256('20260907:' || id) LIMIT 100)
    SELECT '20260907' AS seed, 'SHA256(seed + '':'' + stable_sample_id) ascending' AS selection_method, 100::BIGINT AS sample_size_requested,
    (SELECT count(*) FROM s) AS sample_size_actual, (SELECT count(*) FROM corpus) AS full_count,
    (SELECT count(*) FROM corpus WHERE token_count <= 512) AS eligible_count, (SELECT count(*) FROM corpus WHERE token_count > 512) AS excluded_count,
    (SELECT string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) FROM s) AS selected_ids""",
)
def sample_manifest(spark, d):
    rows = corpus(spark, d).withColumnRenamed("summary", "reference")
    chosen = sample.by_hash(lengths.eligible(rows), 100, "20260907")
    return sample.manifest(chosen, lengths.eligibility(rows), 100, "20260907")


@query(
    "uniform_sample",
    "SELECT o_orderkey FROM orders ORDER BY sha256('7:' || o_orderkey), o_orderkey LIMIT 250",
)
def uniform_sample(spark, d):
    return sample.uniform(read(spark, d, "orders").select("o_orderkey"), 250, 7, "o_orderkey")


QUANTILE_SAMPLE_SQL = f"""WITH {CORPUS_SQL}, r AS (SELECT id, token_count, sha256('42:' || id) AS h FROM corpus),
n50 AS (SELECT * FROM r ORDER BY abs(token_count - (SELECT quantile_cont(token_count, 0.5) FROM r)), id LIMIT 128),
c50 AS (SELECT * FROM n50 ORDER BY h, id LIMIT 8),
n75 AS (SELECT * FROM r ORDER BY abs(token_count - (SELECT quantile_cont(token_count, 0.75) FROM r)), id LIMIT 128),
c75 AS (SELECT * FROM n75 WHERE id NOT IN (SELECT id FROM c50) ORDER BY h, id LIMIT 8),
n90 AS (SELECT * FROM r ORDER BY abs(token_count - (SELECT quantile_cont(token_count, 0.9) FROM r)), id LIMIT 128),
c90 AS (SELECT * FROM n90 WHERE id NOT IN (SELECT id FROM c50 UNION ALL SELECT id FROM c75) ORDER BY h, id LIMIT 8),
band AS (SELECT CASE WHEN count(*) FILTER (token_count BETWEEN 448 AND 511) >= 16 THEN 64 ELSE 128 END AS width FROM r),
st AS (SELECT r.*, width FROM r, band WHERE token_count BETWEEN 512 - width AND 511 ORDER BY h, id LIMIT 16)
SELECT id, token_count, 'p50' AS kind FROM c50 UNION ALL SELECT id, token_count, 'p75' FROM c75
UNION ALL SELECT id, token_count, 'p90' FROM c90 UNION ALL SELECT id, token_count, 'within_' || width FROM st"""


@query("quantile_sample", QUANTILE_SAMPLE_SQL)
def quantile_sample(spark, d):
    return sample.around_quantiles(corpus(spark, d), "token_count", "id", stress=16, widths=(64, 128))


@query(
    "rolling_mean",
    """WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events),
    w AS (SELECT *, avg(value) OVER (PARTITION BY event_type ORDER BY r ROWS 99 PRECEDING) AS m FROM p)
    SELECT event_type, r AS rows_seen, round(m, 6) AS rolling_mean FROM w WHERE r % 50 = 0""",
)
def rolling_mean(spark, d):
    found = stats.rolling_mean(read(spark, d, "events"), "event_type", "event_id", "value", 100, 50)
    return rounded(found, ["rolling_mean"])
