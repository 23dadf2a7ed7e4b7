import hashlib
import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from articleflow.operators import corpus, evals, ingest, lengths, manifest, quality, reads, sample, stats, tasks, users
from articleflow.operators.ordering import ordered_scan, position
from articleflow.plans import summarise
from articleflow.plans.jobs import Round, run_round
from articleflow.sources.versions import VersionedTables
from articleflow.plans.mapping import as_of
from articleflow.sources import jsonl, runs, sinks
from articleflow.sources.schemas import FAVORITES, FEEDBACK, MODEL_EVALUATIONS, NEWS_ARTICLES, RAW_ARTICLE

T = datetime(2026, 9, 5, 10)
NOW = "2026-09-05 12:00:00"


def article(id, status="pending", content=None, **over):
    row = dict.fromkeys(NEWS_ARTICLES.names)
    row.update(
        id=id, title=f"标题{id}", content=content or f"正文{id}", category="科技", source="测试来源", source_url=f"https://e.invalid/{id}",
        content_hash=f"{id:064d}", publish_time=T, crawl_time=T, summary_status=status, created_at=T, updated_at=T,
    )
    row.update(over)
    return tuple(row[n] for n in NEWS_ARTICLES.names)


def articles(spark, *rows):
    return spark.createDataFrame(list(rows), NEWS_ARTICLES)


def raw(spark, *rows):
    return spark.createDataFrame(
        [(i, t, c, k, "测试来源", u, T) for i, (t, c, k, u) in enumerate(rows)],
        "seq long, title string, content string, category string, source string, source_url string, publish_time timestamp_ntz",
    )


def test_ingest_keeps_first_and_rejects(spark):
    new = raw(
        spark, ("标题甲", "相同正文", "科技", "u"), ("标题乙", "相同正文", "科技", "u"), ("同题", "一", "科技", "u"), ("同题", "二", "科技", "u"),
        ("标题", "正文", "娱乐", "u"), ("  ", "正文", "科技", "u"), ("标题", " \n", "科技", "u"), ("标题", "正文", "国内", "   "),
    )
    got = ingest.outcomes(new, articles(spark), quality.CATEGORIES)
    assert [r.outcome for r in got.orderBy("seq").collect()] == ["created", "deduped", "created", "created"] + ["rejected"] * 4
    row = ingest.stats(got).first()
    assert (row.fetched, row.created, row.deduped, row.rejected) == (8, 3, 1, 4)
    fresh = ingest.with_hash(new).join(got.where("outcome = 'created'").select("seq"), "seq", "left_semi")
    table = ingest.append(fresh, articles(spark, article(7)), as_of(NOW))
    saved = {r.id: r for r in table.collect()}
    assert sorted(saved) == [7, 8, 9, 10] and saved[8].title == "标题甲" and saved[8].summary_status == "pending"
    assert saved[8].summary is None and saved[8].created_at == datetime(2026, 9, 5, 12)
    assert table.schema.names == NEWS_ARTICLES.names and [f.dataType for f in table.schema] == [f.dataType for f in NEWS_ARTICLES]
    again = ingest.outcomes(new, table, quality.CATEGORIES)
    assert again.where("outcome = 'created'").count() == 0
    assert set(RAW_ARTICLE.names) < set(new.columns)


def test_categories_and_client_ids(spark):
    assert [r.category for r in quality.categories(spark).orderBy("ord").collect()] == ["科技", "财经", "社会", "体育", "国内", "国际"]
    good = "550e8400-e29b-41d4-a716-446655440000"
    df = spark.createDataFrame([(f"  {good.upper()} ",), (good[:-1],), (good.replace("-41", "-11"),), (None,)], "client_id string")
    ok, bad = quality.split_client_ids(df)
    assert [r.client_id for r in ok.collect()] == [good]
    assert sorted(r.reason for r in bad.collect()) == ["bad_length", "bad_length", "not_uuid4"]


def test_page_order_and_limits(spark):
    df = articles(spark, article(1), article(2, publish_time=None), article(3), article(4, publish_time=datetime(2026, 9, 6)), article(5, publish_time=None))
    page = reads.page(df, 1, 3)
    assert [r.id for r in page.collect()] == [4, 3, 1] and page.first().total == 5 and page.first().has_more
    assert "content" not in page.columns
    assert [r.id for r in reads.page(df, 2, 3).collect()] == [5, 2]
    for bad in ({"number": 0}, {"size": 51}, {"size": 0}, {"category": "娱乐"}):
        with pytest.raises(ValueError):
            reads.page(df, **bad)
    bare = reads.detail(df, spark.createDataFrame([], FAVORITES), spark.createDataFrame([], FEEDBACK), 1).first()
    assert bare.is_favorite is False and bare.feedback is None


def moves(spark, rows):
    return spark.createDataFrame(
        [("c", 1, a, h, i, datetime(2026, 1, 1, 0, i)) for i, (a, h) in enumerate(rows)],
        "client_id string, news_id long, action string, helpful boolean, seq long, ts timestamp_ntz",
    )


@pytest.mark.parametrize("width", [2, 4096])
def test_favorites_and_feedback(spark, width):
    got = users.fold_favorites(moves(spark, [("add", None), ("add", None), ("remove", None), ("add", None), ("add", None)]), width=width).first()
    assert got.id == 3 and got.created_at == datetime(2026, 1, 1, 0, 3)
    assert users.fold_favorites(moves(spark, [("add", None), ("remove", None), ("remove", None)]), width=width).count() == 0
    said = users.fold_feedback(moves(spark, [(None, True), (None, None), (None, False)])).first()
    assert said.helpful is False and said.created_at < said.updated_at == datetime(2026, 1, 1, 0, 2)


def play(events):
    table = {v[0] + k: v[1] for k, v in tasks.TRANSITIONS.items()}
    state, warned = "pending", []
    for i, e in events:
        after = table.get(state + e)
        if after is None:
            warned.append((i, state))
        state = after or state
    return state, warned


@pytest.mark.parametrize("width", [2, 3, 4096])
def test_task_fold_against_replay(spark, width):
    import random

    rng = random.Random(width)
    log = {t: [(i, rng.choice(list(tasks.TRANSITIONS)[:4] + ["delete"] * (t % 2))) for i in sorted(rng.sample(range(60), 25))] for t in range(5)}
    df = spark.createDataFrame([(t, i, e) for t, ev in log.items() for i, e in ev], "task_id long, seq long, event string")
    got = {r.task_id: r for r in tasks.fold(df, width=width).collect()}
    warned = {(r.task_id, r.seq): r.state for r in tasks.ignored(df, width=max(2, width)).collect()}
    for t, ev in log.items():
        state, bad = play(ev)
        assert got[t].status == state and got[t].ignored == len(bad) and got[t].applied == len(ev) - len(bad)
        assert {k: v for k, v in warned.items() if k[0] == t} == {(t, i): s for i, s in bad}


def test_scan_and_position_in_small_buckets(spark):
    df = spark.createDataFrame([("k", i, 9 - i) for i in range(10)], "k string, seq long, v long")
    flip = F.array(F.lit(1), F.lit(0))
    got = ordered_scan(df, ["k"], "seq", flip, width=2).orderBy("seq").collect()
    assert [r.state_before for r in got] == [0, 1] * 5
    placed = position(df, ["k"], [F.col("v")], F.floor(F.col("v") / 3), "p").collect()
    assert all(r.p == r.v + 1 for r in placed)


def test_task_snapshot_moves(spark):
    df = articles(spark, article(1), article(2, "processing", summary="旧"), article(3, "completed", summary="完成"), article(4, "failed", summary_error="超时"))
    claimed = {r.id: r.summary_status for r in tasks.claim(df, as_of(NOW)).collect()}
    assert claimed == {1: "processing", 2: "processing", 3: "completed", 4: "failed"}
    results = spark.createDataFrame(
        [(2, "failed", None, 1, None, "e" * 700), (3, "ok", "新", 5, "v", None), (1, "ok", "新", 5, "v", None)],
        "id long, outcome string, summary string, generation_time_ms long, model_version string, error string",
    )
    done = {r.id: r for r in tasks.apply(df, results, as_of(NOW)).collect()}
    assert done[2].summary_status == "failed" and len(done[2].summary_error) == 500 and done[2].summary == "旧"
    assert done[3].summary == "完成" and done[1].summary_status == "pending"
    ids = spark.createDataFrame([(3,), (4,), (99,)], "id long")
    _, answer = tasks.request(df, ids, as_of(NOW))
    assert {r.news_id: r.summary_status for r in answer.collect()} == {3: "completed", 4: "pending"}
    stale = {r.id: r for r in tasks.recover_stale(df, as_of(NOW)).collect()}
    assert stale[2].summary_status == "failed" and stale[2].summary_error == tasks.STALE_REASON.format(minutes=10)
    fresh = {r.id: r.summary_status for r in tasks.recover_stale(df, as_of("2026-09-05 10:09:59")).collect()}
    assert fresh[2] == "processing"
    zombie = {r.id: r.summary_status for r in tasks.reset_zombie(df, spark.createDataFrame([(2,), (3,)], "id long"), as_of(NOW)).collect()}
    assert zombie == {1: "pending", 2: "pending", 3: "completed", 4: "failed"}
    many = articles(spark, *[article(i) for i in range(24)])
    seen = []
    for _ in range(4):
        now = tasks.claim(many, as_of(NOW), 6)
        hit = [r.id for r in now.where("summary_status = 'processing'").collect()]
        seen.append(len(hit))
        many = now
    assert seen == [6, 12, 18, 24]


def test_delete_reaches_dependents_only_from_processing(spark):
    df = articles(spark, article(1, "processing"), article(2))
    fav = spark.createDataFrame([(1, "a", 1, T), (2, "a", 2, T)], FAVORITES)
    fb = spark.createDataFrame([(1, "a", 1, True, T, T)], FEEDBACK)
    kept, fav2, fb2, report = tasks.delete_unprocessable(df, fav, fb, spark.createDataFrame([(1,), (2,)], "id long"))
    assert [r.id for r in kept.collect()] == [2] and [r.news_id for r in fav2.collect()] == [2] and fb2.count() == 0
    assert {r.news_id: r.removed for r in report.collect()} == {1: 2, 2: -1}


def test_round(spark, tmp_path):
    long = "超长内容。" * 200
    table = articles(
        spark, article(1, content="今天天气很好。我们决定去公园。"), article(2, content=long), article(3, content="12345"),
        article(4, "processing"), article(5, "completed", content="别的"),
    )
    fav = spark.createDataFrame([(1, "a", 2, T)], FAVORITES)
    fb = spark.createDataFrame([], FEEDBACK)
    new = raw(spark, ("新", "公园里有很多人。大家都很高兴。", "国内", "u"), ("坏", "正文", "娱乐", "u"))
    with pytest.raises(ValueError):
        run_round(table, fav, fb, [new], as_of(NOW))
    done = run_round(table, fav, fb, [new], as_of(NOW), token_count=F.length("content").cast("long"))
    row = done.summary_stats.first()
    assert (row.completed, row.failed, row.deleted) == (2, 1, 1)
    crawl = done.crawl_stats.first()
    assert (crawl.fetched, crawl.created, crawl.rejected) == (2, 1, 1)
    store = VersionedTables(spark, str(tmp_path / "v"))
    assert store.latest() is None and done.write(str(tmp_path / "v")) == 1
    got = {r.id: r for r in store.read("articles").collect()}
    assert {i: r.summary_status for i, r in got.items()} == {1: "completed", 3: "failed", 4: "failed", 5: "completed", 6: "completed"}
    assert got[1].summary == "今天天气很好。我们决定去公园。" and store.read("favorites").count() == 0
    idle = run_round(table, fav, fb, [new], as_of(NOW), skip_crawl=True, skip_summary=True)
    assert idle.crawl_stats is None and idle.articles.where("summary_status = 'pending'").count() == 3


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    lines = ["﻿" + json.dumps({"id": 1, "article": ["甲", "乙"], "summary": "s", "label": [0]}, ensure_ascii=False), "", "{bad", "[1]", "null", '{"id": "x"}', "  "]
    path.write_text("\n".join(lines), encoding="utf-8")
    got = jsonl.scan(spark, str(path)).orderBy("line_no").collect()
    assert [(r.line_no, r.status) for r in got] == list(
        enumerate(["ok", "empty_line", "json_decode", "not_dict", "not_dict", "ok", "empty_line"], 1)
    )
    norm = corpus.normalise(jsonl.scan(spark, str(path)).where("line_no = 1"), "train").first()
    assert (norm.id, norm.article, norm.article_sentences, norm.label, norm.adequacy) == ("1", "甲 乙", ["甲", "乙"], "[0]", None)
    with pytest.raises(Exception, match="json_decode|empty_line|not_dict"):
        jsonl.scan_strict(spark, str(path)).collect()
    (tmp_path / "b.jsonl").write_text(lines[0] + "\n", encoding="utf-8")
    assert jsonl.scan_strict(spark, str(tmp_path / "b.jsonl")).count() == 1
    (tmp_path / "c.jsonl").write_text('{"id": 1, "article": [" "], "summary": "s"}', encoding="utf-8")
    with pytest.raises(Exception, match="empty article"):
        jsonl.scan_strict(spark, str(tmp_path / "c.jsonl")).collect()
    out = str(tmp_path / "out")
    sinks.jsonl(spark.createDataFrame([(1, None)], "a int, b string"), out)
    assert spark.read.text(out).first().value == '{"a":1,"b":null}'
    with pytest.raises(Exception):
        sinks.jsonl(spark.range(1), out)


def test_line_numbers_over_split_files(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("\n".join(f'{{"n": {i}}}' for i in range(1, 3001)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = jsonl.scan(spark, str(path)).select("line_no", F.try_variant_get("record", "$.n", "int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3000 and all(r.line_no == r.n for r in rows)


def test_quantiles_against_sorting(spark):
    import random

    rng = random.Random(4)
    for size in (1, 2, 3, 5, 11, 400, 30_000):
        values = [float(rng.choice([1, 2, 3, 1000, rng.random()])) for _ in range(size)]
        ordered = sorted(values)
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for r in stats.quantiles(df, "v", [0.05, 0.5, 0.75, 0.9, 0.95, 0.99]).collect():
            place = (size - 1) * r.ratio
            low, high = int(place), min(int(place) + (place > int(place)), size - 1)
            want = ordered[low] + (ordered[high] - ordered[low]) * (place - low)
            assert r["quantile"] == pytest.approx(want), (size, r.ratio)
    five = spark.createDataFrame([(i,) for i in range(1, 6)], "v int")
    assert stats.quantiles(five, "v", [0.95]).first()["quantile"] == pytest.approx(4.8)


def test_lengths_and_latency(spark):
    df = spark.createDataFrame([(4,), (5,)], "token_count int")
    row = lengths.eligibility(df, 4).first()
    assert tuple(row) == (2, 1, 1, 0.5)
    assert lengths.eligibility(df.where("false")).first().eligible_ratio == 0.0
    dom = spark.createDataFrame([(511,), (512,), (513,)], "n int").select(lengths.domain(F.col("n")).alias("d"))
    assert [r.d for r in dom.collect()] == ["lt512", "eq512", "gt512"]
    ms = spark.createDataFrame([(1499.9,), (1500.0,)], "generation_time_ms double")
    got = evals.latency(ms).first()
    assert got.latency_pass_count == 1 and got.latency_pass_rate == 0.5
    none = evals.latency(ms.where("false")).first()
    assert none.sample_count == 0 and none.p95_generation_time_ms is None and none.latency_pass_rate is None
    met = spark.createDataFrame([(0.95, 1499.9), (0.94, 100.0), (None, 1.0)], "latency_pass_rate double, p95_generation_time_ms double")
    assert [r.latency_target_met for r in evals.latency_met(met).collect()] == [True, False, False]
    sc = spark.createDataFrame([("evaluated", 0.4, 0.4, 0.4), ("evaluated", 0.8, 0.8, 0.8)], "status string, rouge1 double, rouge2 double, rougeL double")
    assert evals.aggregate(sc).first().rougeL == pytest.approx(0.6)
    assert tuple(evals.quality(sc).first()) == (2, 1.0)
    assert evals.aggregate(sc.where("false")).first().evaluated_count == 0 and evals.quality(sc.where("false")).first().quality_pass_rate is None


def test_sample_ignores_input_order(spark):
    rows = [(i, f"a{i}", f"r{i}") for i in range(400)]
    make = lambda r: spark.createDataFrame(r, "id long, article string, reference string")
    a = [r.id for r in sample.by_hash(make(rows), 300, "20260907").collect()]
    b = [r.id for r in sample.by_hash(make(rows[::-1]).repartition(7), 300, "20260907").collect()]
    assert a == b and len(set(a)) == 300
    assert sample.by_hash(make(rows[:2]), 300, "20260907").count() == 2
    import hashlib

    assert a == sorted(range(400), key=lambda i: hashlib.sha256(f"20260907:{i}".encode()).hexdigest())[:300]
    with pytest.raises(ValueError):
        sample.by_hash(make(rows), 0, "x")


RATIOS = [0.0, 0.1, 0.5, 0.75, 0.99, 1.0]


def _inside(spark, rows, by, most):
    """Most distinct values that any bracket encloses."""
    held = stats.brackets(rows, RATIOS, by, most).select(*by, F.explode("_w._t").alias("t"))
    met = rows.join(held, by) if by else rows.crossJoin(held)
    inside = met.where("_v >= t.from and _v <= t.to").groupBy(*by, "t.ratio").agg(F.count_distinct("_v").alias("n"))
    return inside.agg(F.max("n")).first()[0]


def test_quantile_brackets_narrow_to_a_bound(spark):
    rows = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("_v"))
    assert _inside(spark, rows, [], 100_000) > 300
    assert _inside(spark, rows, [], 20) <= 22
    wide = {r.ratio: r.quantile for r in stats.quantiles(rows, "_v", RATIOS).collect()}
    assert wide == {r.ratio: r.quantile for r in stats.quantiles(rows, "_v", RATIOS, most=20).collect()}
    values = sorted(r._v for r in rows.collect())
    assert all(wide[r] == pytest.approx(np.quantile(values, r)) for r in RATIOS)


def test_quantile_brackets_pass_heavy_values(spark):
    """A third of all rows is one value next to wanted ranks; groups and a null group."""
    light = F.when(F.col("id") % 3 == 0, 500.0).otherwise((F.col("id") * 31 % 9973) / 10)
    rows = spark.range(60_000).select(F.when(F.col("id") < 50_000, "a").when(F.col("id") < 59_000, "b").alias("g"), light.alias("_v"))
    pdf = rows.where("g is not null").toPandas()
    got = stats.quantiles(rows, "_v", RATIOS, ["g"], most=3).collect()
    assert len(got) == 12
    for r in got:
        assert r.quantile == pytest.approx(np.quantile(pdf[pdf.g == r.g]["_v"], r.ratio))
    assert _inside(spark, rows, ["g"], 3) <= 6


def test_rank_outside_its_bracket_is_an_error(spark):
    rows = spark.range(100).select(F.col("id").cast("double").alias("_v"))
    moved = lambda t: t.withField("from", F.lit(70.0)).withField("to", F.lit(80.0))
    wrong = stats.brackets(rows, [0.5], []).withColumn("_w", F.col("_w").withField("_t", F.transform("_w._t", moved)))
    with pytest.raises(Exception, match="outside its bracket"):
        stats._select(rows, wrong, []).collect()


def test_manifest_must_map(spark):
    base = spark.createDataFrame([(0, "a", 5), (1, "b", 600)], "source_index long, id string, token_count int")
    good = manifest.rejoin(base, manifest.build(base))[1]
    assert manifest.require_complete(good).count() == 1
    wrong = spark.createDataFrame([(0, "z", 5)], "source_index long, id string, token_count int")
    with pytest.raises(Exception, match="manifest"):
        manifest.require_complete(manifest.rejoin(base, wrong)[1]).collect()


def test_runs_skip_unreadable_and_evaluations(spark, tmp_path):
    for name, text in (("a", '{"run_id": "a", "task": "B2-10", "formal_result": true, "acceptance_status": "passed"}'), ("b", "{oops"),
                       ("c", '{"run_id": "c", "task": "B2-14"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(text)
    found = runs.read(spark, str(tmp_path / "*" / "run.json"))
    assert sorted(r.run_id for r in found.collect()) == ["a", "c"]
    assert runs.latest(found, runs.accepted_quality()).first().run_id == "a"
    assert evals.latest(spark.createDataFrame([], MODEL_EVALUATIONS)).count() == 0


def test_sample_fingerprint_is_a_tree(spark):
    ids = [0, 1, 2, 5, 9, 10]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = {i: digest(f'{{"id":{i}}}') for i in ids}
    for _ in range(2):
        up = {}
        for i in sorted(rows):
            up.setdefault(i // 3, []).append(rows[i])
        rows = {i: digest("\n".join(v)) for i, v in up.items()}
    want = digest("\n".join(rows[i] for i in sorted(rows)))
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "id long")
    assert corpus.sample_fingerprint(df, ["id"], "id", width=3).first().digest == want


def _tree_digest(pairs, width, depth):
    """Brute force: (order, row digest) pairs; repeats by sums, then levels of ranges."""
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    places = {}
    for at, row in pairs:
        places.setdefault(at, []).append(row)
    rows = {}
    for at, all_rows in places.items():
        sums = [str(sum(int(r[8 * i:8 * i + 8], 16) for r in all_rows)) for i in range(8)]
        rows[at] = all_rows[0] if len(all_rows) == 1 else digest(":".join([str(len(all_rows)), *sums]))
    largest = 0
    for level in range(depth):
        up = {}
        for at in sorted(rows, key=lambda a: (a is not None, a or 0)):
            to = 0 if level == depth - 1 else at if at is None else at // width
            up.setdefault(to, []).append(rows[at])
        largest = max(largest, *map(len, up.values()))
        rows = {at: digest("\n".join(v)) for at, v in up.items()}
    return rows[0], largest


@pytest.mark.parametrize(
    "orders, depth",
    [([-(1 << 63), -5, 3, 3, 3, 1 << 62, (1 << 63) - 1, None, None], 16), ([7] * 500 + [8], 3), (list(range(-40, 300)), 3), ([None], 3)],
)
def test_sample_fingerprint_of_sparse_and_repeated_orders(spark, orders, depth):
    rows = [(i, at) for i, at in enumerate(orders)]
    text = lambda i, at: f'{{"id":{i},"at":{"null" if at is None else at}}}'
    pairs = [(at, hashlib.sha256(text(i, at).encode()).hexdigest()) for i, at in rows]
    want, largest = _tree_digest(pairs, 16, depth)
    df = spark.createDataFrame(rows[::-1], "id long, at long")
    assert corpus.sample_fingerprint(df, ["id", "at"], "at", width=16).first().digest == want
    assert largest <= 17
    assert corpus.sample_fingerprint(df.limit(0), ["id", "at"], "at").count() == 0


def test_odd_values_are_refused_field_by_field(spark, tmp_path):
    for name, text in (
        ("a", '{"run_id": "a", "task": "B2-10", "formal_result": "true", "evaluated_count": 5.5, "rouge1": 1}'),
        ("b", '{"run_id": "b", "task": 7, "formal_result": true, "evaluated_count": "5", "rouge1": "0.5", "rouge2": null, "more": [1]}'),
        ("c", '{"run_id": 5, "task": "B2-10"}'), ("d", "17"), ("e", ""), ("f", '[{"run_id": "f"}]'),
        ("g", '{\n"run_id": "g",\n"evaluated_count": 12, "rouge1": 1e-1}'),
    ):
        (tmp_path / f"{name}.json").write_text(text)
    found = {r.run_id: r for r in runs.read(spark, str(tmp_path / "*.json")).collect()}
    assert sorted(found) == ["a", "b", "g"]
    assert (found["a"].task, found["a"].formal_result, found["a"].evaluated_count, found["a"].rouge1) == ("B2-10", None, None, 1.0)
    assert (found["b"].task, found["b"].formal_result, found["b"].evaluated_count, found["b"].rouge1) == (None, True, None, None)
    assert (found["g"].evaluated_count, found["g"].rouge1) == (12, 0.1)
    counts = {r.field: r.refused for r in runs.refused(spark, str(tmp_path / "*.json")).collect() if r.refused}
    assert counts == {"task": 1, "formal_result": 1, "evaluated_count": 2, "rouge1": 1}


def test_samples_around_quantiles_need_a_full_band(spark):
    rows = spark.createDataFrame([(i, 400 + i) for i in range(100)], "id long, v long")
    got = sample.around_quantiles(rows, "v", "id", near=6, picks=2, stress=3, upper=480, widths=(2, 8)).collect()
    assert [sum(r.kind == k for r in got) for k in ("p50", "p75", "p90", "within_2", "within_8")] == [2, 2, 2, 0, 3]
    assert all(472 <= r.v <= 479 for r in got if r.kind == "within_8")
    assert all(abs(r.v - 449.5) <= 3 for r in got if r.kind == "p50")
    with pytest.raises(Exception, match="fewer than 9 rows"):
        sample.around_quantiles(rows, "v", "id", stress=9, upper=480, widths=(2, 8)).collect()
    with pytest.raises(ValueError):
        sample.around_quantiles(rows, "v", "id", near=5000)


def test_two_sources_number_their_rows_alone(spark, tmp_path):
    row = lambda *r: (*r, "u", None)
    schema = "seq long, title string, content string, category string, source string, source_url string, publish_time timestamp_ntz"
    a = spark.createDataFrame([(1, *row("一", "甲文", "国内", "A")), (2, *row("二", "乙文", "国内", "A"))], schema)
    b = spark.createDataFrame([(1, *row("三", "丙文", "娱乐", "B")), (2, *row("四", "甲文", "国内", "B"))], schema)
    table = articles(spark).limit(0)
    fav, fb = spark.createDataFrame([], FAVORITES), spark.createDataFrame([], FEEDBACK)
    loaders = {"A": lambda: a, "broken": lambda: spark.read.text(str(tmp_path / "nothing")), "late": lambda: b.select(F.raise_error(F.lit("gone")).alias("x")), "B": lambda: b}
    loaded, failed = ingest.fetch_sources(spark, loaders)
    assert len(loaded) == 2 and set(failed) == {"broken", "late"}
    done = run_round(table, fav, fb, loaded, as_of(NOW), skip_summary=True)
    stats = {r.source: (r.fetched, r.created, r.deduped, r.rejected) for r in done.crawl_stats.collect()}
    assert stats == {"A": (2, 2, 0, 0), "B": (2, 0, 1, 1)}
    assert [(r.id, r.title) for r in done.articles.orderBy("id").collect()] == [(1, "一"), (2, "二")]
    with pytest.raises(ValueError):
        ingest.union_sources([])


@pytest.mark.parametrize("wrong", [lambda texts: texts[:1], lambda texts: [*texts, "extra"], lambda texts: []])
def test_a_wrong_number_of_outputs_never_shifts_summaries(spark, wrong):
    rows = [(i, "ok", f"text {i}", f"text {i}", None) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, outcome string, cleaned string, selected string, error string").coalesce(1)
    make = lambda: lambda texts: list(texts) if len(texts) == 1 else wrong(texts)
    got = summarise.batch(df, make, batch_size=2).collect()
    assert {r.id: r.summary for r in got} == {i: f"text {i}" for i in range(5)}
    none = summarise.batch(df, lambda: lambda texts: [], batch_size=2).collect()
    assert {(r.outcome, r.summary) for r in none} == {("failed", None)}


def test_normalise_keeps_bad_lines(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_text('{"id": 1, "article": ["x"]}\n{bad\n{"id": 2, "article": "text"}\n', encoding="utf-8")
    made = corpus.normalise(jsonl.scan(spark, str(path)), "train")
    assert sorted(r.status for r in made.collect()) == ["json_decode", "not_list", "ok"]
    account = corpus.line_accounts(made).first()
    assert (account.lines, account.records, account.refused) == (3, 1, 2)


def test_empty_groups_have_a_distribution(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "k string, v double")
    got = {r.k: (r["count"], r["mean"]) for r in stats.distribution(df, ["v"], ["k"]).collect()}
    assert got == {"a": (1, 1.0), "b": (0, None), None: (1, 3.0)}
    empty = stats.distribution(df.limit(0), ["v"]).collect()
    assert [(r["count"], r["mean"], r["max"]) for r in empty] == [(0, None, None)]


def test_versions_are_published_whole_or_not_at_all(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "v"))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert Round(rows(1, 2), rows(1), rows(2)).write(str(tmp_path / "v")) == 1
    broken = rows(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):  # the first table of the new version is written, the second fails
        Round(rows(1), broken, rows()).write(str(tmp_path / "v"))
    ids = lambda name, version=None: sorted(r.id for r in store.read(name, version).collect())
    assert store.latest()[0] == 1 and (ids("articles"), ids("favorites"), ids("feedback")) == ([1, 2], [1], [2])
    # again, from the tables it replaces
    kept = Round(store.read("articles").where("id = 1"), store.read("favorites"), store.read("feedback").where("id = 1"))
    assert kept.write(str(tmp_path / "v"), after=1) == 2
    assert (ids("articles"), ids("favorites"), ids("feedback"), ids("articles", 1)) == ([1], [1], [], [1, 2])
    with pytest.raises(RuntimeError, match="after 1"):
        kept.write(str(tmp_path / "v"), after=1)
    with pytest.raises(ValueError):
        store.read("other")
