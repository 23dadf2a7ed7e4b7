"""Streams over several micro-batches equal their batch form; replays change nothing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from articleflow.operators import tasks, users
from articleflow.streaming import streams


def _parts(spark, tmp_path, rows, schema, name):
    folder = tmp_path / name
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i : i + 40], schema).coalesce(1).write.parquet(str(folder / f"{name}-{i:04d}.parquet"))
    flat = tmp_path / f"{name}-in"
    flat.mkdir()
    for at, part in enumerate(sorted(folder.glob("*/part*.parquet"))):
        target = flat / f"{name}-{at:03d}.parquet"
        target.write_bytes(part.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + at, 1_700_000_000 + at))
    return str(flat)


def test_task_stream_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [(rng.randrange(5), i, rng.choice(list(tasks.TRANSITIONS)[:4])) for i in range(200)]
    schema = "task_id long, seq long, event string"
    source = _parts(spark, tmp_path, rows, schema, "log")
    stream = streams.read(spark, source, "log", schema, files_per_batch=1)
    got = streams.task_states(stream, str(tmp_path / "out"))
    assert (tmp_path / "out/segments/batch=4").exists()
    want = tasks.fold(spark.createDataFrame(rows, schema))
    assert sorted(got.collect()) == sorted(want.collect())
    log = spark.read.parquet(str(tmp_path / "out/segments"))
    early = streams.compact(log.where("batch < 3"), ["task_id"], tasks.merge_tasks, str(tmp_path / "compact"))
    both = early.select(log.columns).unionByName(log.where("batch >= 3"))
    again = tasks.state_rows(streams.current(both, ["task_id"], tasks.merge_tasks))
    assert sorted(again.collect()) == sorted(want.collect())


def test_interaction_streams_equal_batch(spark, tmp_path):
    import random

    rng = random.Random(2)
    at = datetime(2026, 1, 1)
    rows = [
        (f"c{rng.randrange(3)}", rng.randrange(3), rng.choice(["add", "remove", None]), rng.choice([True, False, None]), i, at + timedelta(minutes=i))
        for i in range(160)
    ]
    schema = "client_id string, news_id long, action string, helpful boolean, seq long, ts timestamp_ntz"
    source = _parts(spark, tmp_path, rows, schema, "inter")
    batch = spark.createDataFrame(rows, schema)
    stream = lambda: streams.read(spark, source, "inter", schema, files_per_batch=1)
    cols = ["client_id", "news_id", "id", "created_at"]
    got = streams.favorite_states(stream(), str(tmp_path / "f")).select(cols)
    assert sorted(got.collect()) == sorted(users.fold_favorites(batch).select(cols).collect())
    cols = ["client_id", "news_id", "helpful", "created_at", "updated_at"]
    said = streams.feedback_states(stream(), str(tmp_path / "b")).select(cols)
    assert sorted(said.collect()) == sorted(users.fold_feedback(batch).select(cols).collect())


def test_ingest_stream_is_exactly_once(spark, tmp_path):
    from articleflow.operators import extract
    from articleflow.plans.mapping import as_of

    body = lambda k: f"<title>标题</title><div id='article_inbox'><p>{'正文内容' * 20}{k}</p></div>"
    rows = [(i, f"https://news.gmw.cn/2026-01/01/content_{i}.htm", body(i % 7), "国内") for i in range(120)]
    schema = "page_id long, url string, html string, category string"
    source = _parts(spark, tmp_path, rows, schema, "pages")
    read = lambda: streams.read(spark, source, "pages", schema, files_per_batch=1)
    now = as_of("2026-01-01 12:00:00")
    got = streams.ingest(read(), extract.SOURCE_B, now, str(tmp_path / "out"), ["国内"])
    assert sorted(r.seq for r in got.collect()) == list(range(7))
    again = streams.ingest(read(), extract.SOURCE_B, now, str(tmp_path / "out"), ["国内"])
    assert again.count() == 7


def test_late_events_meet_the_guard(spark, tmp_path):
    rows = [(1, 10, "claim"), (1, 11, "complete")] + [(2, 100 + i, "claim") for i in range(38)] + [(1, 5, "fail")]
    schema = "task_id long, seq long, event string"
    source = _parts(spark, tmp_path, rows, schema, "late")
    got = streams.task_states(streams.read(spark, source, "late", schema, 1), str(tmp_path / "out"))
    row = got.where(F.col("task_id") == 1).first()
    assert (row.status, row.ignored) == ("completed", 1)


def brute_timed(rows, minutes, until):
    """Events of each task in event time; the deadline is judged before every event and once more at the end."""
    found = {}
    for task, seq, event, at in sorted(rows, key=lambda r: (r[3], r[1])):
        s = found.setdefault(task, ["pending", 0, 0, 0, None, None])
        if s[0] == "processing" and s[5] + timedelta(minutes=minutes) < at:
            s[0], s[3] = "failed", s[3] + 1
        needs, leads = tasks.TRANSITIONS[event]
        if s[0] == needs:
            s[0], s[1], s[4], s[5] = leads, s[1] + 1, seq, at
        else:
            s[2] += 1
    for s in found.values():
        if s[0] == "processing" and s[5] + timedelta(minutes=minutes) < until:
            s[0], s[3] = "failed", s[3] + 1
    return sorted((task, *s[:5]) for task, s in found.items())


def test_stale_tasks_fail_by_timer(spark, tmp_path):
    import random

    from articleflow.streaming import stale

    rng = random.Random(4)
    start, rows = datetime(2026, 1, 1), []
    for i in range(200):
        rows.append((rng.randrange(12), i, rng.choice(["claim", "claim", "complete", "request", "fail"]), start + timedelta(minutes=2 * i, seconds=rng.randrange(60))))
    rows += [(50, 200, "claim", rows[10][3]), (51, 201, "claim", rows[-1][3])]  # one waits for its timer, one is not late yet
    rows += [(52, 202, "claim", rows[20][3]), (52, 203, "complete", rows[60][3])]  # completed too late
    rows.sort(key=lambda r: r[3])
    schema = "task_id long, seq long, event string, at timestamp"
    source = _parts(spark, tmp_path, rows, schema, "timed")
    stream = streams.read(spark, source, "timed", schema, files_per_batch=1)
    got = stale.task_states_with_timer(stream, str(tmp_path / "out"), minutes=10, delay="5 minutes")
    states = sorted(map(tuple, got.collect()))
    until = max(r[3] for r in rows) - timedelta(minutes=5)
    assert states == brute_timed(rows, 10, until)
    by_task = {r[0]: r for r in states}
    assert by_task[50][1:4:2] == ("failed", 0) and by_task[50][4] == 1 and by_task[51][1] == "processing"
    assert by_task[52] == (52, "failed", 1, 1, 1, 202)
    batches = {int(p.name.split("=")[1]) for p in (tmp_path / "out/states").glob("batch=*")}
    assert len(batches) > 5


def test_open_and_closed_windows_count_every_event(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(i % 3, "ab"[i % 2], start + timedelta(minutes=7 * i)) for i in range(160)]
    schema = "k long, kind string, at timestamp"
    source = _parts(spark, tmp_path, rows, schema, "win")
    stream = lambda: streams.read(spark, source, "win", schema, files_per_batch=1)
    counts = streams.window_stats(stream(), "at", "kind", "3 hours", "1 hour")
    got = streams.all_windows(counts, str(tmp_path / "w"), "kind")
    want = spark.createDataFrame(rows, schema).groupBy(F.window("at", "3 hours", "1 hour").alias("w"), "kind").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("w.start", "w.end", "kind", "count").collect()))
    closed = spark.read.parquet(str(tmp_path / "w/rows")).count()
    assert 0 < closed < got.count()
    sessions = streams.all_sessions(streams.session_stats(stream(), "at", "k", "15 minutes"), str(tmp_path / "s"), "k")
    whole = spark.createDataFrame(rows, schema).groupBy(F.session_window("at", "15 minutes").alias("w"), "k").count()
    assert sorted(map(tuple, sessions.collect())) == sorted(map(tuple, whole.select("w.start", "w.end", "k", "count").collect()))


def test_content_index_reads_stay_level(spark, tmp_path):
    import hashlib
    import re

    from articleflow.streaming.content_index import ContentIndex, runs_before

    assert runs_before(0) == [] and runs_before(21) == [(0, 16), (16, 20), (20, 21)]
    for n in range(200):
        runs = runs_before(n)
        assert [a for a, _ in runs] == [0, *(b for _, b in runs[:-1])][: len(runs)] and (not n or runs[-1][1] == n)
    index = ContentIndex(spark, str(tmp_path / "index"), fan=2, buckets=4)
    seen, files = set(), []
    for batch in range(20):
        words = {hashlib.sha256(str(batch * 3 + k).encode()).hexdigest() for k in range(7)}  # overlaps earlier batches
        rows = spark.createDataFrame([(w,) for w in sorted(words)], "content_hash string").coalesce(1)
        fresh = {r[0] for r in index.unknown(rows, batch).collect()}
        assert fresh == words - seen
        files.append(len(index.known(rows, batch).inputFiles()))
        kept = spark.createDataFrame([(w,) for w in sorted(fresh)], "content_hash string")
        for _ in range(1 + (batch == 7)):  # a replay writes the same
            index.add(kept, batch)
        seen |= words
    assert max(files) <= 4 * 5 and files[16] <= 4 and files[19] <= 4 * 3
    one = spark.createDataFrame([(min(seen),)], "content_hash string")
    plan = index.known(one, 16)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_ingest_reads_a_folder_and_keeps_the_first_by_number(spark, tmp_path):
    """A table may be a folder of files, in no order: the first copy of a content may lie in a later file."""
    import os

    from articleflow.operators import extract
    from articleflow.plans.mapping import as_of

    body = lambda k: f"<title>标题{k}</title><div id='article_inbox'><p>{'正文内容' * 20}{k}</p></div>"
    rows = [(i, f"https://news.gmw.cn/2026-01/01/content_{i}.htm", body(i % 7), "国内") for i in range(120)]
    schema = "page_id long, url string, html string, category string"
    parts = _parts(spark, tmp_path, rows, schema, "pages")
    folder = tmp_path / "set[1]" / "pages.parquet"
    folder.mkdir(parents=True)
    for at, part in enumerate(sorted(os.listdir(parts), reverse=True)):
        target = folder / f"part-{at:03d}.parquet"
        target.write_bytes((tmp_path / "pages-in" / part).read_bytes())
        os.utime(target, (1_700_000_000 + at, 1_700_000_000 + at))
    read = streams.read(spark, str(folder.parent), "pages", schema, files_per_batch=1)
    got = streams.ingest(read, extract.SOURCE_B, as_of("2026-01-01 12:00:00"), str(tmp_path / "out"), ["国内"])
    assert sorted((r.seq, r.title) for r in got.collect()) == [(i, f"标题{i}") for i in range(7)]
