import math
import random

import numpy as np
import pytest

from articleflow.operators import rank, vectors
from articleflow.plans import summarise


def brute(vs, similarity=None):
    n = len(vs)
    if similarity is None:
        unit = [np.array(v, float) / (np.linalg.norm(v) or 1e-8) for v in vs]
        similarity = [[max(0.0, float(a @ b)) for b in unit] for a in unit]
    for i in range(n):
        similarity[i][i] = 0.0
    score = [1 / n] * n
    out = [sum(row) or 1.0 for row in similarity]
    for _ in range(100):
        fresh = [0.15 / n + 0.85 * sum(similarity[j][i] / out[j] * score[j] for j in range(n)) for i in range(n)]
        change = sum(abs(a - b) for a, b in zip(fresh, score))
        score = fresh
        if change < 1e-4:
            break
    return score


GROUPS = {
    1: [[1.0, 0.0, 0.0], [1.0, 2.0, 0.0], [1.0, 0.0, 2.0], [1.0, -2.0, 0.0]],
    2: [[0.0] * 3, [1.0] * 3, [0.0] * 3],
    3: [[1.0, 2.0, 3.0]],
    4: [[random.Random(i).uniform(-1, 1) for _ in range(3)] for i in range(23)],
}


@pytest.mark.parametrize("limit, block", [(1000, 512), (2, 5)])
def test_dense_scores(spark, limit, block):
    rows = [(g, i, v) for g, vs in GROUPS.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "doc long, item long, v array<float>")
    got = {(r.doc, r.item): r.score for r in rank.dense_scores(df, "doc", "item", "v", limit, block).collect()}
    assert len(got) == len(rows)
    for g, vs in GROUPS.items():
        for i, want in enumerate(brute(vs)):
            assert got[g, i] == pytest.approx(want, abs=1e-6)
    assert [round(got[1, i], 6) for i in range(4)] == pytest.approx([0.372352, 0.191915, 0.243817, 0.191915], abs=2e-6)
    assert got[3, 0] == pytest.approx(0.15)
    assert [got[2, i] for i in range(3)] == pytest.approx([0.05] * 3)


def _sparse_docs():
    rng = random.Random(11)
    docs = {}
    for doc in range(6):
        docs[doc] = [
            {rng.randrange(9): rng.uniform(0.1, 2) for _ in range(rng.randint(0, 4))} for _ in range(rng.randint(1, 14))
        ]
    return docs


@pytest.mark.parametrize("limit", [10_000, 6])
def test_sparse_scores(spark, limit):
    docs = _sparse_docs()
    cells = [(d, i, t, w) for d, ss in docs.items() for i, s in enumerate(ss) for t, w in s.items()]
    vecs = spark.createDataFrame(cells, "doc_id long, sent_idx long, term int, weight double")
    nodes = spark.createDataFrame([(d, len(s)) for d, s in docs.items()], "doc_id long, sentences long")
    got = {(r.doc_id, r.sent_idx): r.score for r in rank.scores(vecs, nodes, max_cells=limit).collect()}
    for d, ss in docs.items():
        dense = [[s.get(t, 0.0) for t in range(9)] for s in ss]
        for i, want in enumerate(brute(dense)):
            assert got[d, i] == pytest.approx(want, abs=1e-6)


def test_degrees_in_blocks(spark):
    rows = [(1, i, v) for i, v in enumerate(GROUPS[4])]
    df = spark.createDataFrame(rows, "doc long, item long, v array<double>")
    got = {r.item: (r.neighbours, r.out_sum) for r in rank.degrees(df, "doc", "item", "v", block=4).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for v in GROUPS[4]]
    for i, a in enumerate(unit):
        sims = [max(0.0, float(a @ b)) for j, b in enumerate(unit) if j != i]
        assert got[i][0] == sum(s > 0 for s in sims) and got[i][1] == pytest.approx(sum(sims))


def test_one_label_is_spread_over_cells(spark):
    rng = np.random.default_rng(3)
    vs = rng.normal(size=(400, 5))
    ids = [int(i) for i in rng.choice(1 << 60, 400, replace=False)]
    extra = [(1, ids[0] + 1, None), (None, 5, [1.0] * 5), (1, None, [1.0] * 5)]
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in zip(ids, vs)] + extra, "doc long, item long, v array<double>")
    blocks = rank.unit_blocks(df, "doc", "item", "v", block=16)
    sizes = blocks.selectExpr("size(ids) as n").collect()
    assert sum(r.n for r in sizes) == 400 and len(sizes) == 26 and max(r.n for r in sizes) < 48
    held = rank.cells(blocks).groupBy("i", "j").count().collect()
    assert len(held) == 5 * 6 // 2 and max(r["count"] for r in held) <= 12
    got = {r.item: (r.neighbours, r.out_sum) for r in rank.degrees(df, "doc", "item", "v", block=16).collect()}
    unit = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    sims = np.clip(unit @ unit.T, 0, None)
    np.fill_diagonal(sims, 0)
    assert len(got) == 400
    for i, row in zip(ids, sims):
        assert got[i][0] == (row > 0).sum() and got[i][1] == pytest.approx(row.sum())


def _split(sentence, most):
    if len(sentence) <= most:
        return [sentence]
    clauses, held = [], ""
    for ch in sentence:
        held += ch
        if ch in "，,、；;":
            clauses.append(held)
            held = ""
    clauses += [held] if held else []
    done, held = [], ""
    for c in clauses:
        if len(held) + len(c) <= most:
            held += c
            continue
        done += [held] if held else []
        while len(c) > most:
            done.append(c[:most])
            c = c[most:]
        held = c
    return [p for p in done + ([held] if held else []) if p.strip()]


def _greedy(sentences, scores, budget):
    need = lambda s: max(1, math.ceil(len(s) / 2))
    used, chosen = 0, {}
    for i in sorted(range(len(sentences)), key=lambda i: -scores[i]):
        offers = [sentences[i]] if need(sentences[i]) <= budget - used else _split(sentences[i], budget * 2)
        for piece in offers:
            if need(piece) <= budget - used:
                chosen.setdefault(i, []).append(piece)
                used += need(piece)
    return [p for i in sorted(chosen) for p in chosen[i]]


def _select(spark, docs, budget):
    rows = [(d, i, s, x) for d, (ss, xs) in docs.items() for i, (s, x) in enumerate(zip(ss, xs))]
    df = spark.createDataFrame(rows, "doc_id long, sent_idx long, sentence string, score double")
    return {r.doc_id: r.pieces for r in rank.select_budget(df, budget).collect()}


def test_budget_literals(spark):
    docs = {
        1: (["甲句。", "乙句。", "丙句。"], [0.9, 0.1, 0.5]),
    }
    assert _select(spark, docs, 500)[1] == ["甲句。", "乙句。", "丙句。"]
    three = {1: (["这是第一句很长。", "这是第二句很长。", "这是第三句很长。"], [0.1, 0.9, 0.2])}
    assert "这是第二句很长。" in _select(spark, three, 10)[1]
    long = {1: (["，".join(["这是非常关键的长句内容" * 10] * 5), "次要不重要。", "补充信息句。"], [0.9, 0.05, 0.05])}
    assert 0 < len("".join(_select(spark, long, 20)[1])) <= 40


def test_budget_against_brute_force(spark):
    rng = random.Random(2)
    docs = {
        d: (
            ["".join(rng.choice("甲乙丙丁，；戊 ") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 12))],
            None,
        )
        for d in range(40)
    }
    docs = {d: (ss, [rng.randrange(4) / 4 for _ in ss]) for d, (ss, _) in docs.items()}
    got = _select(spark, docs, 20)
    for d, (ss, xs) in docs.items():
        assert got[d] == _greedy(ss, xs, 20), (d, ss, xs)


def test_extractive_end_to_end(spark):
    rows = [
        (1, "今天天气很好。我们决定去公园。公园里的天气很好！", 30),
        (2, "超长", 513),
        (3, "12345。", 5),
        (4, " ​ ", 5),
    ]
    df = spark.createDataFrame(rows, "id long, content string, token_count long")
    got = {r.id: r for r in summarise.extractive(df).collect()}
    assert got[1].outcome == "ok" and got[1].selected == "今天天气很好。我们决定去公园。公园里的天气很好!"
    assert got[2].outcome == "too_long" and got[2].error.startswith("输入正文过长：513 token")
    assert got[3].error == summarise.NO_SENTENCES and got[4].error == summarise.EMPTY_AFTER_CLEANING


def test_batch_isolates_failures_and_gate_rejects(spark):
    rows = [(i, "ok", "8月增长4.5%。", t, None) for i, t in enumerate(["8月增长4 . 5 %", "坏", "上半年增长4.5%", ""])]
    df = spark.createDataFrame(rows, "id long, outcome string, cleaned string, selected string, error string").coalesce(1)

    def make():
        def predict(texts):
            if "坏" in texts:
                raise ValueError("bad")
            return list(texts)

        return predict

    got = {r.id: r for r in summarise.gate(summarise.batch(df, make, "m1")).collect()}
    assert (got[0].outcome, got[0].summary, got[0].model_version) == ("ok", "8月增长4.5%", "m1")
    assert (got[1].outcome, got[1].error) == ("failed", "ValueError: bad")
    assert got[2].outcome == "failed" and got[2].error == summarise.FACTS_REJECTED + "time_range: 上半年（源文无依据）"
    assert (got[3].outcome, got[3].error) == ("failed", summarise.EMPTY_SUMMARY)


def test_model_hook_and_mean_pool(spark):
    df = spark.createDataFrame([(1, "甲"), (2, "乙丙")], "id long, sentence string")

    def make():
        return lambda xs: np.array([[len(x), 1.0] for x in xs], dtype="float32")

    got = {r.id: list(r.vector) for r in vectors.encode_with_model(df, make).collect()}
    assert got == {1: [1.0, 1.0], 2: [2.0, 1.0]}
    toks = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (1, [9.0, 9.0], 0)], "id long, vector array<double>, mask int")
    assert vectors.mean_pool(toks, ["id"]).first().vector == [2.0, 4.0]


def test_prefix_budget_is_a_lower_bound(spark):
    rows = [(1, i, s, x) for i, (s, x) in enumerate([("甲" * 10, 0.9), ("乙" * 30, 0.8), ("丙" * 4, 0.7)])]
    df = spark.createDataFrame(rows, "doc_id long, sent_idx long, sentence string, score double")
    assert [r.sent_idx for r in rank.prefix_budget(df, 10).collect()] == [0]
    # The second sentence is longer than the whole budget, so its last piece may fill the rest.
    assert rank.select_budget(df, 10).first().pieces == ["甲" * 10, "乙" * 10]
