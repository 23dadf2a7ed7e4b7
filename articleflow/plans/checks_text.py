"""Text, facts, ranking and summaries over the given tables."""

from pyspark.sql import functions as F

from articleflow.functions import fact_text, text
from articleflow.functions.summary_text import normalise_summary
from articleflow.operators import facts, rank, vectors
from articleflow.plans import summarise
from articleflow.plans.catalogue import query
from articleflow.plans.mapping import rounded
from articleflow.session import staged
from articleflow.sources.tables import read, read_spread

ENDERS = ".!?"
WORDS = r"[\p{L}0-9]+"


@query(
    "clean_text",
    r"""SELECT doc_id, sha256(trim(regexp_replace(replace(text, chr(10), ''), '[ \t]+', ' ', 'g'))) AS cleaned_hash FROM documents""",
)
def clean_text(spark, d):
    docs = read_spread(spark, d, "documents", "doc_id")
    return docs.select("doc_id", text.sha256(text.clean(F.col("text"))).alias("cleaned_hash"))


SENTENCES_SQL = r"""
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
parts AS (SELECT doc_id, ln, unnest(p) AS s, generate_subscripts(p, 1) AS pn FROM (SELECT doc_id, ln,
  regexp_extract_all(regexp_replace(line, '^\s+|\s+$', '', 'g'), '[^.!?]*[.!?][.!?”’」』）)\]"'']*|[^.!?]+$') AS p FROM lines)),
kept AS (SELECT doc_id, ln, pn, regexp_replace(s, '^\s+|\s+$', '', 'g') AS sentence FROM parts WHERE length(regexp_replace(s, '\P{L}', '', 'g')) >= 2),
sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln, pn) - 1 AS sent_idx, sentence FROM kept)"""


def _sentences(spark, d):
    found = text.sentence_array(F.col("text"), ENDERS, "letters")
    rows = read_spread(spark, d, "documents", "doc_id").select("doc_id", F.posexplode(found).alias("sent_idx", "sentence"))
    return rows.withColumn("sent_idx", F.col("sent_idx").cast("long"))


@query("sentences", f"WITH {SENTENCES_SQL} SELECT doc_id, sent_idx, sentence FROM sentences")
def sentences(spark, d):
    return _sentences(spark, d)


@query(
    "est_tokens",
    f"WITH {SENTENCES_SQL} SELECT doc_id, sent_idx, greatest(1, ceil(length(sentence) / 2.0))::BIGINT AS tokens FROM sentences",
)
def est_tokens(spark, d):
    return _sentences(spark, d).select("doc_id", "sent_idx", text.est_tokens(F.col("sentence")).alias("tokens"))


PIECES_SQL = SENTENCES_SQL + f""",
long AS (SELECT doc_id, sent_idx, sentence FROM sentences WHERE length(sentence) > LIMIT),
clauses AS (SELECT doc_id, sent_idx, list_transform(regexp_extract_all(sentence, '[^，,、；;]*[，,、；;]|[^，,、；;]+$'),
  lambda c: {{'done': CAST([] AS VARCHAR[]), 'open': c}}) AS l FROM long),
packed AS (SELECT doc_id, sent_idx, list_reduce(l, lambda a, x: CASE WHEN length(a.open) + length(x.open) <= LIMIT
   THEN {{'done': a.done, 'open': a.open || x.open}}
   ELSE {{'done': list_concat(CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END,
     CAST(list_transform(generate_series(0, (length(x.open) - 1) // LIMIT - 1), lambda k: substr(x.open, (k * LIMIT + 1)::BIGINT, LIMIT)) AS VARCHAR[])),
     'open': substr(x.open, ((length(x.open) - 1) // LIMIT * LIMIT + 1)::BIGINT, LIMIT)}} END,
   {{'done': CAST([] AS VARCHAR[]), 'open': ''}}) AS f FROM clauses),
flat AS (SELECT doc_id, sent_idx, list_filter(list_append(f.done, f.open), lambda p: trim(p) <> '') AS p FROM packed),
pieces AS (SELECT doc_id, sent_idx, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS piece_idx FROM flat)"""
SPLIT_SQL = f"WITH {PIECES_SQL} SELECT * FROM pieces".replace("LIMIT", "80")


@query("split_long", SPLIT_SQL)
def split_long(spark, d):
    rows = _sentences(spark, d).where(F.length("sentence") > 80)
    pieces = F.posexplode(text.split_long(F.col("sentence"), 80)).alias("piece_idx", "piece")
    return rows.select("doc_id", "sent_idx", pieces).withColumn("piece_idx", F.col("piece_idx").cast("long"))


DOT = r"'([0-9])\s*\.\s*([0-9])', '\1.\2', 'g'"


@query(
    "normalise_summary",
    rf"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, {DOT}), {DOT}), '\s*%', '%', 'g'), '\s+', ' ', 'g'))) AS h
    FROM documents""",
)
def normalised(spark, d):
    docs = read_spread(spark, d, "documents", "doc_id")
    return docs.select("doc_id", text.sha256(normalise_summary(F.col("text"))).alias("h"))


FACTS_SQL = r"""
src AS (SELECT o_orderkey AS doc_id, 'Im Jahr ' || year(o_orderdate) || '年' || month(o_orderdate) || '月 ' || round(o_totalprice / 5000, 1) || '% und ' ||
  (o_custkey % 10) || '成, ' || CASE WHEN o_custkey % 2 = 0 THEN '上半年' ELSE '下半年' END AS t FROM orders),
cand AS (SELECT o_orderkey AS doc_id, (year(o_orderdate) + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) || '年' || month(o_orderdate) || '月 约' ||
  (o_custkey % 7) || '成, ' || round(o_totalprice / 4800, 1) || '%' || CASE WHEN o_orderstatus = 'F' THEN '上半年' ELSE '' END AS t FROM orders),
txt AS (SELECT doc_id, 'src' AS side, t FROM src UNION ALL SELECT doc_id, 'cand', t FROM cand),
pat(fact_type, k, p) AS (VALUES ('percent', 0, '[0-9]+(?:\.[0-9]+)?%'), ('percent', 1, '[超约近]?[0-9]+(?:\.[0-9]+)?[成]'), ('month', 0, '[0-9]{1,2}月'),
  ('year', 0, '20[0-2][0-9]年'), ('year', 1, '19[0-9]{2}年'), ('time_range', 0, '上半年'), ('time_range', 1, '下半年'), ('number', 0, '[0-9]+(?:\.[0-9]+)?')),
m AS (SELECT doc_id, side, fact_type, k, unnest(regexp_extract_all(t, p)) AS fact, generate_subscripts(regexp_extract_all(t, p), 1) AS i FROM txt, pat),
fct AS (SELECT doc_id, side, fact_type, row_number() OVER (PARTITION BY doc_id, side, fact_type ORDER BY k, i) - 1 AS fact_idx, fact FROM m),
val AS (SELECT *, CASE WHEN ends_with(fact, '%') THEN fact[:-2]::DOUBLE ELSE regexp_extract(fact, '([0-9.]+)成', 1)::DOUBLE * 10 END AS v FROM fct WHERE fact_type = 'percent'),
badpct AS (SELECT doc_id, fact_type, fact_idx, fact FROM val c WHERE side = 'cand' AND NOT EXISTS (SELECT 1 FROM val s WHERE s.side = 'src' AND s.doc_id = c.doc_id
  AND CASE WHEN s.v = 0 THEN c.v = 0 ELSE abs(c.v - s.v) / abs(s.v) < 0.15 END)),
badexact AS (SELECT doc_id, fact_type, fact_idx, fact FROM fct c WHERE side = 'cand' AND fact_type IN ('month', 'year', 'time_range') AND NOT EXISTS
  (SELECT 1 FROM fct s WHERE s.side = 'src' AND s.doc_id = c.doc_id AND s.fact_type = c.fact_type AND s.fact = c.fact))"""


def _grounded(spark, d):
    """Orders as short texts with years, months, shares and half-years, and as summaries of them."""
    o = read_spread(spark, d, "orders", "o_orderkey")
    year, month = F.year("o_orderdate"), F.month("o_orderdate").cast("string")
    share = lambda by: F.round(F.col("o_totalprice") / by, 1).cast("string")
    source = F.concat(
        F.lit("Im Jahr "), year.cast("string"), F.lit("年"), month, F.lit("月 "), share(5000), F.lit("% und "),
        (F.col("o_custkey") % 10).cast("string"), F.lit("成, "),
        F.when(F.col("o_custkey") % 2 == 0, "上半年").otherwise("下半年"),
    )
    shifted = year + F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    candidate = F.concat(
        shifted.cast("string"), F.lit("年"), month, F.lit("月 约"), (F.col("o_custkey") % 7).cast("string"), F.lit("成, "),
        share(4800), F.lit("%"), F.when(F.col("o_orderstatus") == "F", "上半年").otherwise(""),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), source.alias("source_text"), candidate.alias("candidate"))


@query("facts", f"WITH {FACTS_SQL} SELECT doc_id, fact_type, fact_idx, fact FROM fct WHERE side = 'src'")
def fact_rows(spark, d):
    return facts.extract(_grounded(spark, d), "source_text")


@query("percent_values", f"WITH {FACTS_SQL} SELECT doc_id, side, fact_idx, round(v, 6) AS v FROM val")
def percent_values(spark, d):
    texts = _grounded(spark, d)
    both = [
        facts.extract(texts, c).where("fact_type = 'percent'").withColumn("side", F.lit(s))
        for c, s in (("source_text", "src"), ("candidate", "cand"))
    ]
    value = fact_text.percent_value(F.col("fact"))
    return rounded(both[0].unionByName(both[1]).select("doc_id", "side", "fact_idx", value.alias("v")), ["v"])


@query(
    "unsupported_facts",
    f"WITH {FACTS_SQL} SELECT * FROM badpct UNION ALL SELECT * FROM badexact",
)
def unsupported_facts(spark, d):
    texts = _grounded(spark, d)
    # both checks read the facts of both sides, so these are extracted once
    mine, known = (staged(facts.extract(texts, c, types=facts.COMPARED), "facts") for c in ("candidate", "source_text"))
    cols = ["doc_id", "fact_type", "fact_idx", "fact"]
    return facts.unsupported(mine, known).select(*cols).unionByName(facts.unsupported_pct(mine, known).select(*cols))


@query(
    "fact_check",
    f"""WITH {FACTS_SQL}, bad AS (SELECT * FROM badpct UNION ALL SELECT * FROM badexact)
    SELECT src.doc_id, count(fact) AS violations, count(fact) = 0 AS passed FROM src LEFT JOIN bad USING (doc_id) GROUP BY src.doc_id""",
)
def fact_check(spark, d):
    texts = _grounded(spark, d)
    checked = facts.check(texts, texts)
    return checked.select("doc_id", F.size("violations").cast("long").alias("violations"), "passed")


TFIDF_SQL = SENTENCES_SQL + r""",
tokens AS (SELECT doc_id, sent_idx, unnest(regexp_extract_all(lower(sentence), '[\p{L}0-9]+')) AS token FROM sentences),
tf AS (SELECT doc_id, sent_idx, (('0x' || substr(md5(token), 1, 8))::BIGINT % 4096)::INTEGER AS term, count(*) AS tf FROM tokens GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, sent_idx, term, tf * ln(((SELECT count(*) FROM sentences) + 1) / (df + 1)) AS weight FROM tf JOIN df USING (term))"""


@query("tfidf_vectors", f"WITH {TFIDF_SQL} SELECT doc_id, sent_idx, term, round(weight, 6) AS weight FROM w")
def tfidf_vectors(spark, d):
    return rounded(vectors.encode(_sentences(spark, d), token_pattern=WORDS), ["weight"])


GRAPH_SQL = """
u AS (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
e AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, greatest(0, list_dot_product(a.v, b.v)) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id),
o AS (SELECT label, i, sum(s) AS out_sum, count(*) FILTER (s > 0) AS neighbours FROM e GROUP BY ALL)"""


@query("cosine_degrees", f"WITH {GRAPH_SQL} SELECT label, i AS vec_id, neighbours, round(out_sum, 6) AS out_sum FROM o")
def cosine_degrees(spark, d):
    found = rank.degrees(read(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return rounded(found, ["out_sum"])


RANK_EMBEDDINGS_SQL = f"""WITH RECURSIVE {GRAPH_SQL}, n AS (SELECT label, count(*) AS n FROM u GROUP BY label),
    t AS (SELECT e.label, e.i, e.j, s / CASE WHEN out_sum = 0 THEN 1 ELSE out_sum END AS p FROM e JOIN o ON o.label = e.label AND o.i = e.i),
    it(k, label, id, score, done) AS (SELECT 0, u.label, vec_id, 1.0::DOUBLE / n, false FROM u JOIN n USING (label)
      UNION ALL SELECT k + 1, label, id, fresh, sum(abs(fresh - score)) OVER (PARTITION BY label) < 1e-4 FROM (
        SELECT it.k, it.label, it.id, it.score, 0.85 * coalesce(z.z, 0) + 0.15 / n.n AS fresh FROM it JOIN n USING (label)
        LEFT JOIN (SELECT t.label, t.j, sum(t.p * x.score) AS z FROM t JOIN it x ON x.label = t.label AND x.id = t.i GROUP BY ALL) z
          ON z.label = it.label AND z.j = it.id WHERE NOT it.done AND it.k < 100))
    SELECT label, id AS vec_id, round(arg_max(score, k), 6) AS score FROM it GROUP BY label, id"""


@query("rank_embeddings", RANK_EMBEDDINGS_SQL)
def rank_embeddings(spark, d):
    return rounded(rank.dense_scores(read(spark, d, "embeddings"), "label", "vec_id", "embedding"), ["score"])


@query("rank_embeddings_blocks", RANK_EMBEDDINGS_SQL)
def rank_embeddings_blocks(spark, d):
    """The way of groups beyond one batch: every label by cells of block products."""
    found = rank.dense_scores(read(spark, d, "embeddings"), "label", "vec_id", "embedding", max_sentences=1, block=32)
    return rounded(found, ["score"])


@query("rank_sentences")
def rank_sentences(spark, d):
    """Rows only: iterating in SQL over all documents is too slow; tests compare with brute force."""
    rows = staged(_sentences(spark, d), "sentences")
    nodes = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))
    sizes = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("cells"))
    return rounded(rank.scores(vectors.encode(rows, token_pattern=WORDS), nodes, sizes=sizes), ["score"])


def _valued(spark, d):
    """Sentences with a score that needs no model: a hash of the sentence, in 0..1."""
    score = (F.conv(F.substring(F.md5("sentence"), 1, 4), 16, 10).cast("long") % 50) / 50
    return _sentences(spark, d).withColumn("score", score)


VALUED_SQL = SENTENCES_SQL + """,
valued AS (SELECT *, (('0x' || substr(md5(sentence), 1, 4))::BIGINT % 50) / 50 AS score,
  greatest(1, ceil(length(sentence) / 2.0))::BIGINT AS need FROM sentences)"""


@query(
    "prefix_budget",
    f"""WITH {VALUED_SQL}, run AS (SELECT doc_id, sent_idx, sum(need) OVER (PARTITION BY doc_id ORDER BY score DESC, sent_idx
    ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM valued) SELECT doc_id, sent_idx, used FROM run WHERE used <= 120""",
)
def prefix_budget(spark, d):
    return rank.prefix_budget(_valued(spark, d), 120).select("doc_id", "sent_idx", "used")


@query(
    "budget_select",
    f"""WITH {PIECES_SQL}, items AS (SELECT doc_id, sent_idx, 0 AS piece_idx, sentence AS t, sentence FROM sentences WHERE length(sentence) <= LIMIT
      UNION ALL SELECT doc_id, sent_idx, piece_idx, piece, sentence FROM pieces JOIN sentences USING (doc_id, sent_idx)),
    valued AS (SELECT doc_id, sent_idx, piece_idx, t, (('0x' || substr(md5(sentence), 1, 4))::BIGINT % 50) / 50 AS score,
      greatest(1, ceil(length(t) / 2.0))::BIGINT AS need FROM items),
    l AS (SELECT doc_id, list({{'used': need, 'txt': [{{'i': sent_idx, 'k': piece_idx, 's': t}}]}} ORDER BY score DESC, sent_idx, piece_idx) AS l
      FROM valued GROUP BY doc_id),
    g AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN a.used + x.used <= 120 THEN {{'used': a.used + x.used, 'txt': list_concat(a.txt, x.txt)}} ELSE a END,
      {{'used': 0::BIGINT, 'txt': CAST([] AS STRUCT(i BIGINT, k BIGINT, s VARCHAR)[])}}) AS f FROM l)
    SELECT doc_id, len(f.txt) AS pieces, array_to_string(list_transform(list_sort(f.txt), lambda t: t.s), '') AS chosen FROM g""".replace("LIMIT", "240"),
)
def budget_select(spark, d):
    return rank.select_budget(_valued(spark, d), 120).select(
        "doc_id", F.size("pieces").cast("long").alias("pieces"), F.array_join("pieces", "").alias("chosen")
    )


def _drafts(spark, d):
    docs = read_spread(spark, d, "documents", "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.ceil(F.col("n_chars") / 4).alias("token_count")
    )
    return summarise.extractive(docs, 512, 2.0, ENDERS, "letters", "id", WORDS)


@query(
    "extractive_outcomes",
    r"""SELECT doc_id AS id, CASE WHEN ceil(n_chars / 4.0) > 512 THEN 'too_long' WHEN len(list_filter(regexp_extract_all(replace(text, chr(10), ''),
      '[^.!?]*[.!?][.!?”’」』）)\]"'']*|[^.!?]+$'), lambda s: length(regexp_replace(s, '\P{L}', '', 'g')) >= 2)) = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM documents""",
)
def extractive_outcomes(spark, d):
    return _drafts(spark, d).select("id", "outcome")


@query("extractive")
def extractive(spark, d):
    """Rows only: cleaned, ranked and selected text; stages have their own SQL."""
    return _drafts(spark, d).select("id", "outcome", text.sha256(F.col("selected")).alias("selected_hash"), "error")


def _marking():
    """A stand-in model: marks the text; refuses texts with a digit."""

    def predict(texts):
        for t in texts:
            if any(c.isdigit() for c in t):
                raise ValueError("digits")
        return ["S:" + t for t in texts]

    return predict


@query(
    "batch_generate",
    """SELECT doc_id AS id, CASE WHEN n_chars > 4000 THEN 'too_long' WHEN regexp_matches(text, '[0-9]') THEN 'failed' ELSE 'ok' END AS outcome,
    CASE WHEN n_chars > 4000 OR regexp_matches(text, '[0-9]') THEN '' ELSE sha256('S:' || text) END AS summary_hash,
    CASE WHEN n_chars > 4000 THEN '' WHEN regexp_matches(text, '[0-9]') THEN 'ValueError: digits' ELSE '' END AS error
    FROM documents""",
)
def batch_generate(spark, d):
    long = F.col("n_chars") > 4000
    docs = read_spread(spark, d, "documents", "doc_id").select(
        F.col("doc_id").alias("id"), F.when(long, "too_long").otherwise("ok").alias("outcome"),
        F.col("text").alias("cleaned"), F.when(~long, F.col("text")).alias("selected"), F.lit(None).cast("string").alias("error"),
    )
    made = summarise.batch(docs, _marking, "marked-v1")
    return made.select(
        "id", "outcome", F.coalesce(text.sha256(F.col("summary")), F.lit("")).alias("summary_hash"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query(
    "summary_gate",
    f"""WITH {FACTS_SQL}, bad AS (SELECT * FROM badpct UNION ALL SELECT * FROM badexact),
    b AS (SELECT doc_id, string_agg(fact_type || ': ' || fact || CASE fact_type WHEN 'percent' THEN '（源文无匹配数值）' ELSE '（源文无依据）' END, '；'
      ORDER BY CASE fact_type WHEN 'percent' THEN 0 WHEN 'month' THEN 1 WHEN 'year' THEN 2 ELSE 3 END, fact_idx) AS e FROM bad GROUP BY doc_id)
    SELECT cand.doc_id AS id, CASE WHEN e IS NULL THEN 'ok' ELSE 'failed' END AS outcome,
    CASE WHEN e IS NULL THEN '' ELSE '摘要硬事实校验未通过，不交付：' || e END AS error FROM cand LEFT JOIN b USING (doc_id)""",
)
def summary_gate(spark, d):
    drafts = _grounded(spark, d).select(
        F.col("doc_id").alias("id"), F.lit("ok").alias("outcome"), F.col("source_text").alias("cleaned"),
        F.col("candidate").alias("summary"), F.lit(0).cast("long").alias("generation_time_ms"),
        F.lit("v1").alias("model_version"), F.lit(None).cast("string").alias("error"),
    )
    return summarise.gate(drafts).select("id", "outcome", F.coalesce("error", F.lit("")).alias("error"))


@query(
    "mean_pool",
    """SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings
    WHERE vec_id % 3 > 0) GROUP BY ALL""",
)
def mean_pool(spark, d):
    tokens = read(spark, d, "embeddings").select(
        "label", F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 3 > 0, 1).otherwise(0).alias("mask")
    )
    pooled = vectors.mean_pool(tokens, ["label"])
    return rounded(pooled.select("label", F.posexplode("vector").alias("pos", "x")), ["x"])
