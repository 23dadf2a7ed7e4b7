"""Physical plans keep the shape that holds at scale."""

import math
import re

import pytest
from pyspark.sql import functions as F

from articleflow.operators import rank, rouge
from articleflow.plans import catalogue
from articleflow.sources.tables import read

FOLDER = "/root/testdata/sf0.001"
catalogue.load()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def of(spark, name):
    return plan(catalogue.QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["list_page", "list_page_deep", "hash_sample", "uniform_sample", "latest_eval", "runs_latest"])
def test_top_k_is_never_a_global_sort(spark, name):
    text = of(spark, name)
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_page_reads_only_list_columns(spark):
    text = of(spark, "list_page")
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in text
    assert "o_totalprice" not in text and "o_custkey" not in text


def test_n_grams_are_not_shuffled(spark):
    pairs = spark.createDataFrame([(1, "a b", "b c")], "id long, prediction string, reference string")
    assert len(re.findall(r"Exchange hashpartitioning", plan(rouge.overlap(pairs)))) == 1


def test_first_copies_shuffle_hashes_only(spark):
    from articleflow.operators import ingest
    from articleflow.plans.mapping import document_articles

    text = plan(ingest.first_copies(ingest.with_hash(document_articles(spark, FOLDER)).select("content_hash", "seq")))
    assert "partial_min(seq" in text and len(re.findall("Exchange", text)) == 1


@pytest.mark.parametrize(
    "name",
    ["user_state", "favorites_list", "task_fold", "round_robin", "links_newest_first", "distribution_prices", "rolling_mean",
     "ingest_outcomes", "overlap_pairs", "rouge_overlap", "facts", "unsupported_facts", "cosine_degrees", "constraint_audit", "quantile_sample"],
)
def test_no_cartesian_product(spark, name):
    text = of(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_budget_selection_groups_by_document_only(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0.5)], "doc_id long, sent_idx long, sentence string, score double")
    assert len(re.findall("Exchange", plan(rank.select_budget(rows, 5)))) == 1


def test_spread_leaves_large_scans_alone(spark):
    from articleflow.session import spread

    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, "id") is wide
    assert spread(read(spark, FOLDER, "documents"), "doc_id").rdd.getNumPartitions() == 8


def test_by_key_follows_the_files(spark, monkeypatch):
    from articleflow import session

    documents, orders = read(spark, FOLDER, "documents"), read(spark, FOLDER, "orders")
    cores = spark.sparkContext.defaultParallelism
    number = lambda df, key: int(re.search(r"partitioning\(\w+#\d+L?, (\d+)\)", plan(session.by_key(df, key)))[1])
    assert number(documents, "doc_id") == cores
    monkeypatch.setattr(session, "BYTES_PER_TASK", 1000)
    alone = session.source_bytes(documents)
    assert number(documents, "doc_id") == alone // 1000 > 10 * cores
    joined = documents.join(orders, documents.doc_id == orders.o_orderkey).join(documents.select("doc_id"), "doc_id")
    assert session.source_bytes(joined) == alone + session.source_bytes(orders)
    rows = spark.createDataFrame([(1, "a")], "id long, t string")
    assert session.source_bytes(rows) is None and number(rows, "id") == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["rouge_overlap", "rouge_1", "eval_score", "extractive_outcomes", "batch_generate"])
def test_texts_are_placed_in_a_few_tasks_per_core(spark, name):
    counts = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", of(spark, name))]
    assert all(n <= 4 * spark.sparkContext.defaultParallelism for n in counts)


def test_quantile_samples_rank_inside_tasks_in_one_scan(spark):
    text = of(spark, "quantile_sample")
    assert text.count("FileScan") == 2, text  # one ranks, one selects quantiles; their sketch was made before
    assert "WindowGroupLimit" in text


def test_dense_graph_has_no_join_of_blocks(spark):
    text = of(spark, "cosine_degrees")
    assert "FlatMapGroupsInPandas" in text and re.search(r"hashpartitioning\(doc#\d+, i#\d+L, j#\d+L", text)


def test_vectors_move_once(spark):
    vs = [(1, i, [float(i % 7), 1.0, -float(i % 5)]) for i in range(300)]
    df = spark.createDataFrame(vs, "doc long, item long, v array<double>")
    held, places = rank.held_cells(rank.unit_blocks(df, "doc", "item", "v", block=1))
    assert held.count() == 8 * 9 // 2 and places.count() == 300  # the root of 300 blocks would be 18 strips
    ones = places.select("doc", "id").selectExpr("*", "1.0D as x")
    text = plan(rank.held_step(held, places, ones, True))
    assert not re.search(r"Exchange hashpartitioning\(doc#\d+L, [ij]#", text) and "MapInArrow" in text


def test_sentences_are_read_once(spark):
    from articleflow.operators import vectors

    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([(d, i, f"a b w{i} v{d}" if i else "") for d in range(5) for i in range(4)], "doc_id long, sent_idx long, t string")
    made = vectors.encode(rows.select("doc_id", "sent_idx", F.udf(count, "string")("t").alias("sentence")))
    weights = {(r.doc_id, r.sent_idx, r.term): r.weight for r in made.collect()}
    assert seen.value == 20 and len(weights) == 5 * 3 * 4
    both = spark.range(1).select(vectors.term_of(F.lit("a"))).first()[0]
    assert weights[0, 1, both] == pytest.approx(math.log(21 / 16))  # 20 sentences, also the empty ones; 15 hold it


def test_facts_are_extracted_once(spark):
    text = of(spark, "unsupported_facts")
    assert "regexp_extract_all" not in text and "fact_type" in text


def test_n_grams_are_not_rows(spark):
    rows = [(1, "a b a", "a b c"), (1, "b c", "a b"), (None, None, ""), (2, "a\n文 b", "文 b B")]
    pairs = spark.createDataFrame(rows, "id long, prediction string, reference string")
    assert "Generate" not in plan(rouge.overlap(pairs))
    got = {r["id"]: tuple(r)[1:] for r in rouge.overlap(pairs).collect()}
    # rows of one id are one multiset
    assert got == {1: (5, 5, 5, 2, 3, 3), None: (0,) * 6, 2: (2, 3, 3, 1, 2, 2)}
