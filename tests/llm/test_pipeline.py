"""The pipeline's stages against brute force on the smallest data set."""

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from articleflow.llm import mixing, secrets, simhash, toxicity
from articleflow.llm.common import staged, table
from articleflow.llm.queries_tokens import tokenizer_path
from tests.llm.test_queries import DOCUMENTS, brute_one_of_each

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    given = {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, FOLDER), "test-stage")
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    clean = {d for d, r in given.items() if model.score(model.counts(r["text"] or "")) < 0.3}
    assert set(kept["toxicity"]) == clean and clean != set(given)
    assert set(kept["near_duplicates"]) == brute_one_of_each([(d, given[d]["text"] or "") for d in clean])
    assert set(kept["secrets"]) == set(kept["near_duplicates"])
    for d, r in kept["secrets"].items():
        assert r["text"] == secrets.mask(given[d]["text"]) and r["n_chars"] == len(r["text"])
        assert not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"])
    before = spark.createDataFrame(list(kept["secrets"].values()), DOCUMENTS)
    assert set(kept["mixing"]) == {r["doc_id"] for r in mixing.mix(before).where("sampled").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == set(kept["mixing"])
    # run() itself, id by id: every document's ids once and in order, and they are the library's
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], array("I", bytes(r["ids"])).tolist()))
    assert set(pieces) == set(kept["mixing"])
    for d, parts in pieces.items():
        ids = [i for _, part in sorted(parts) for i in part]
        assert ids == [*library.encode(kept["mixing"][d]["text"] or "", add_special_tokens=False).ids, 0]


def test_edge_cases(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (2, "a b c " * 9000, "en", "a", 54000), (3, "password=abcdefg", "de", "b", None)]
    for name, given in (("rows", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(given, DOCUMENTS).selectExpr("*", "1 as score", "'x' as root").write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        packed = corpus_pipeline.run(spark, folder).collect()
        assert bool(packed) == bool(given)
        # near copies: of the equal rows one stays; the draw of the mixture decides about the others
        kept = corpus_pipeline.near_duplicate_stage(spark, table(spark, folder, "documents"), folder).collect()
        assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept) == ([(1, 0), (2, 54000), (3, 16)] if given else [])
        docs = table(spark, folder, "documents").select(*corpus_pipeline.COLUMNS)
        drawn = mixing.mix(docs).where("sampled").select("doc_id").collect()
        assert sorted(str(r[0]) for r in mixing.sample(docs).select("doc_id").collect()) == sorted(str(r[0]) for r in drawn)


def test_near_copies_by_fingerprint(spark):
    """Repeated shingles count each time in a fingerprint and once in a set: near copies by the one method alone."""
    rng = np.random.default_rng(8)
    line = " ".join(f"w{k}" for k in range(40))
    tail = lambda: " ".join(f"t{k}" for k in rng.integers(0, 1 << 30, 30))
    texts = [f"{line} " * 60 + tail(), f"{line} " * 60 + tail(), tail(), None, ""]
    (a, _), (b, _) = ((simhash.fingerprint(t), t) for t in texts[:2])
    x, y = (set(simhash.shingle_set(t).tolist()) for t in texts[:2])
    assert (a ^ b).bit_count() <= 4 and len(x & y) < 0.8 * len(x | y)
    docs = spark.createDataFrame([(i + 1, t, "en", "s", 1) for i, t in enumerate(texts)], DOCUMENTS)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4]
