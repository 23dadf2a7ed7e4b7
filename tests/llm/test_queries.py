"""Queries of the training-data operators over edge-case tables and the smallest data set, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from articleflow.llm import merkle, mixing, quality, queries_filters, queries_native, queries_tokens, registry, simhash, toxicity, urls
from tests.llm.test_text_operators import brute_fingerprint, brute_spans

FOLDER = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "Hello there, this is one small text.\nAnd a second line.", "en", "a", 10),
    (2, None, "en", None, None),
    (3, "", None, "b", 0),
    (4, " \n\t ", "de", "b", 4),
    (5, "Hello there, this is one small text.\nAnd a second line.", "en", "a", 10),
    (6, "word " * 3000, "en", "a", 15000),
    (None, "no id here", "fr", "c", 10),
    (7, "Äpfel 😀 password=abcdef12 " + "0a" * 14, "de", "c", 50),
    (7, "Äpfel 😀 password=abcdef12 " + "0a" * 14, "de", "c", 50),
    (9, "x" * 70000, "en", "a", 70000),
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Edge cases with extra columns of names that operators use, and an empty table."""
    made = {}
    for name, rows in (("edge", ROWS), ("empty", [])):
        folder = str(tmp_path_factory.mktemp(name))
        df = spark.createDataFrame(rows, DOCUMENTS)
        if name == "edge":
            df = df.selectExpr("*", "'x' as mark", "1 as tile", "doc_id as score", "'y' as n_tokens", "2 as root", "'z' as topic")
        df.write.parquet(f"{folder}/documents.parquet")
        labels = [(1, 1, 1), (3, 0, 0), (None, 1, 0), (6, None, None), (6, 0, 0)] if rows else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        pages = [(1, None, "h"), (2, "", "h"), (3, "no scheme", "h"), (None, "http://A.Example.COM/en/1?x#y", None), (4, "https://www.example.com/en/2", "h"),
                 (5, "http://x.net/es/", "h"), (6, "http://m.adult-x.example.net/fr", "h"), (6, "http://m.adult-x.example.net/fr", "h"), (7, "http://comx/en/", "h")] if rows else []
        spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
        made[name] = folder
    return made


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_mixing", "op3_url_filter", "op4_packing", "op5_fingerprints", "op6_secrets", "op7_simhash",
                                  "op8_quality", "op9_token_files", "op10_token_counts"])
def test_edge_cases_and_empty_tables(spark, folders, name):
    registry.load()
    assert registry.QUERIES[name](spark, folders["empty"]).count() == 0
    rows = registry.QUERIES[name](spark, folders["edge"]).collect()
    if name == "op4_packing":
        assert sum(r["length"] for r in rows if r["doc_id"] in (2, 3)) == 2
    elif name == "op3_url_filter":
        assert len(rows) == 9
    else:
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)


def test_toxicity_separates(spark):
    rows = queries_filters.op1(spark, FOLDER).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    score = {True: [], False: []}
    for r in rows:
        if r["doc_id"] in labels:
            score[labels[r["doc_id"]] == 1].append(r["score"])
    assert np.mean(score[True]) > np.mean(score[False]) + 0.3


def test_urls(spark, folders):
    rows = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in queries_filters.op3(spark, folders["edge"]).collect()]
    want = [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (None, "a.example.com", "/en/1", "example.com/en/", "block"), (4, "www.example.com", "/en/2", "www.example.com/en/", "allow"),
        (5, "x.net", "/es/", "net/es/", "block"), (6, "m.adult-x.example.net", "/fr", None, "block"),
        (6, "m.adult-x.example.net", "/fr", None, "block"), (7, "comx", "/en/", None, "allow"),
    ]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda text: len(text))  # everything of a length collides
    path = tmp_path / "array"
    path.write_bytes(urls.pack(["abc", "abd", "x", "abc"]))
    assert urls.DigestArray(str(path)).holds(["abc", "abe", "abd", "y", "x", "long"]).tolist() == [True, False, True, False, True, False]
    path.write_bytes(urls.pack([]))
    assert urls.DigestArray(str(path)).holds(["a"]).tolist() == [False]


def test_large_lists_are_joined(spark, folders):
    pages = spark.read.parquet(f"{folders['edge']}/pages.parquet")
    entries = spark.createDataFrame([("host example.com",), ("url http://x.net/es/",), ("host comx",)], "entry string")
    assert {r[0] for r in urls.match_large(pages, entries).collect()} == {None, 4, 5, 7}


def test_packing_covers_each_id_once(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries_tokens.op4(spark, FOLDER).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for groups in ({d: pieces[d] for d in ids}, sequences):
        for key, spans in groups.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == len(ids[key]) if groups is not sequences else at <= 1024 and (at == 1024 or at & (at - 1) == 0)


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r["doc_id"]: r for r in queries_tokens.op9(spark, FOLDER).collect()}
    start = 0
    for doc, text in sorted(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        r = rows[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_counts(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries_tokens.op10(spark, FOLDER).collect()}
    for doc, text in texts:
        n = len(library.encode(text))
        assert rows[doc] == (len(text.encode()), n, n > 4096)


def brute_tree(text):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    leaves = [[md5(p) for p in re.findall(r"[^.!?]{1,16}[.!?]*|[.!?]+", line)] for line in text.split("\n")]
    nodes = [md5("".join(line)) for line in leaves]
    sections = [md5("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    marks = sorted({h[:8] for line in leaves for h in line})[:128]
    return hashlib.sha256("".join(sections).encode()).hexdigest() + ":" + "".join(marks)


def brute_likeness(a, b):
    (root, marks), (other_root, others) = (f.split(":") for f in (a, b))
    if root == other_root:
        return 1.0
    marks, others = ({m[i : i + 8] for i in range(0, len(m), 8)} for m in (marks, others))
    smallest = set(sorted(marks | others)[:128])
    common = len(smallest & marks & others)
    return min(2 * common / (len(smallest) + common), 0.999999) if smallest else 0.0


def test_fingerprints(spark, texts):
    rows = {r["doc_id"]: r for r in queries_native.op5(spark, FOLDER).collect()}
    ordered = sorted(texts, reverse=True)
    for i, (doc, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        r = rows[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 and (r["near_edited"] == 1) == (text == edited)
        assert (r["near_next"] == 1) == (text == following)
        # likeness is computed from the two published fingerprints, which follow from the text alone
        assert r["fingerprint"] == brute_tree(text) and r["edited_fingerprint"] == brute_tree(edited)
        assert r["near_edited"] == pytest.approx(brute_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(brute_likeness(r["fingerprint"], rows[ordered[(i + 1) % len(ordered)][0]]["fingerprint"]))
        assert len(r["fingerprint"]) <= 65 + 8 * merkle.SAMPLE
    long = [rows[d] for d, t in texts if len(t) > 600]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.3


def test_published_fingerprints_suffice(spark):
    from pyspark.sql import functions as F

    pairs = [("One. Two three. Four!", "One. Two three. Five!"), ("", "some"), ("", ""), ("same", "same"), ("w. " * 9 + "".join(f"{i} is here. " for i in range(400)), "x")]
    trees = spark.createDataFrame(pairs, "a string, b string").select(*(merkle.tree(F.col(c)).alias(c) for c in "ab"))
    a, b = F.col("a"), F.col("b")
    parsed = [merkle.from_text(merkle.as_text(x)) for x in (a, b)]
    for r in trees.select(merkle.likeness(a, b).alias("x"), merkle.likeness(*parsed).alias("y"), F.length(merkle.as_text(a)).alias("n")).collect():
        assert r["x"] == r["y"] and r["n"] <= 65 + 8 * merkle.SAMPLE


def test_one_id_is_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 4)
    rows = [(7 if i % 3 else None if i % 2 else i, f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "xxhash64(text) as _tie")
    assert docs.count() == 600 and merkle._bucketed(docs).groupBy("_bucket").count().agg({"count": "max"}).first()[0] < 40


def test_edits_are_located(spark):
    from pyspark.sql import functions as F

    lines = [f"line {i}" for i in range(30)]
    other = [*lines]
    other[11] = "changed"
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other), "\n".join(lines[:20]))], "a string, b string, c string")
    trees = df.select(*(merkle.tree(F.col(c)).alias(c) for c in df.columns))
    row = trees.select(merkle.changed(F.col("a"), F.col("b")).alias("b"), merkle.changed(F.col("a"), F.col("c")).alias("c"), merkle.changed(F.col("a"), F.col("a")).alias("a")).first()
    assert row["b"] == [11] and row["c"] == list(range(20, 30)) and row["a"] == []


@pytest.mark.parametrize("ids", [[5, 3, 9], [1], [0, 1 << 40, 7, 8], [None, 4, None, 2], [3, 3, 3],
                                 [*[3] * 40, *range(-3, 9), *[None] * 30, 1 << 62, -(1 << 62)]])
def test_next_document(spark, monkeypatch, ids):
    for wanted in (1, 256):
        monkeypatch.setattr(merkle, "BUCKET_ROWS", wanted)
        docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
        got = [(r["doc_id"], r["text"], r["next_text"]) for r in merkle.with_next(docs).collect()]
        order = sorted(((i, f"text {n}") for n, i in enumerate(ids)), key=lambda r: (r[0] is None, -(r[0] or 0), np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64)))
        want = [(*row, order[(at + 1) % len(order)][1]) for at, row in enumerate(order)]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_secrets(spark, texts, folders):
    rows = {r["doc_id"]: r for r in queries_filters.op6(spark, FOLDER).collect()}
    names = ["assign", "access", "hex"]
    for doc, text in texts:
        spans = brute_spans(text)
        base = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        counts = Counter(k for _, k, _ in spans)
        r = rows[doc]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts[0], counts[1], counts[2])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def brute_components(texts, radius=4, width=4):
    marks = {d: brute_fingerprint(t, width) for d, t in texts}
    root = {d: d for d in marks}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = list(marks)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (marks[a] ^ marks[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (f"{marks[d]:016x}", top(d)) for d in ids}


@pytest.mark.parametrize("quarters", [0, 1 << 40])
def test_near_duplicates(spark, texts, monkeypatch, quarters):
    monkeypatch.setattr(simhash, "QUARTERS_FROM", quarters)
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries_filters.op7(spark, FOLDER).collect()}
    assert got == brute_components(texts)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def test_one_of_each(spark):
    rows = [(5, "a b c d e", "en", "s", 1), (3, "a b c d e", "en", "s", 1), (3, "a b c d e", "en", "s", 1), (3, "other words here now fully", "en", "s", 1),
            (None, "other words here now fully", "en", "s", 1), (None, "alone as ever was known", "en", "s", 1), (8, None, "en", "s", 1), (9, "", "en", "s", 0)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOCUMENTS)).collect()
    want = [(3, "a b c d e"), (3, "other words here now fully"), (None, "alone as ever was known"), (8, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(want, key=str)


def brute_one_of_each(rows):
    """Smallest id of each component of exact five-word-shingle similarity 0.8 or more."""
    sets, root = {}, {}
    for d, t in rows:
        words = t.lower().split()
        sets[d], root[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}, d

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d for d in sets if top(d) == d}


@pytest.mark.parametrize(("tile", "hot"), [(1 << 17, 512), (100, 512), (1 << 17, 4)])
def test_one_of_each_is_exact(spark, monkeypatch, tile, hot):
    """Also with most shared shingles hot, so that prefixes hold some."""
    monkeypatch.setattr(simhash, "HOT_LEAST", hot)
    monkeypatch.setattr(simhash, "HOT_TIMES", min(8, hot / 8))
    monkeypatch.setattr(simhash, "TILE_SHINGLES", tile)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):  # copies with a few words replaced, on both sides of 0.8, and a line that all have
        base = [f"w{k}" for k in rng.integers(0, 400, int(rng.integers(30, 120)))] + "one line that is in all of these texts".split()
        for _ in range(6):
            words = list(base)
            for k in rng.integers(0, len(words), int(rng.integers(0, max(2, len(words) // 20)))):
                words[k] = f"x{rng.integers(0, 1 << 30)}"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, DOCUMENTS).repartition(4)).collect()}
    want = brute_one_of_each([(r[0], r[1]) for r in rows])
    assert kept == want and 12 < len(want) < len(rows)


def test_one_of_each_short_texts(spark):
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    texts = [word("a", 9), word("a", 8), word("b", 12), word("b", 11), word("c", 13), word("c", 12), word("d", 8), word("d", 7),
             "e f g h i " * 2, "e f g h i " * 3, word("j", 4), word("j", 3)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert kept == brute_one_of_each([(r[0], r[1]) for r in rows]) == {0, 2, 4, 6, 7, 8, 10, 11}


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_statistics(spark, texts):
    given = [*texts, (1000, "a b c d e a b c d e f g"), (1001, "x " * 11), (1002, "a\n a\na\n\n \n a"), (1003, "q w e r t\x0by q w e r t y u")]
    df = spark.createDataFrame(given, "doc_id long, text string")
    for r in quality.statistics(df).collect():
        text = dict(given)[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_statistics(text), text[:80]


def test_quality_rules_are_learned(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13)) for i in range(900)]
    stats = spark.createDataFrame(rows, "doc_id long, x double, y double")
    labels = spark.createDataFrame([(i, int(not (x >= 8 and y < 6))) for i, x, y in rows], "doc_id long, quality int")
    rules = quality.learn(stats, labels, ("x", "y"))
    kept = {r["doc_id"]: r["kept"] for r in stats.select("doc_id", quality.verdict(rules).alias("kept")).collect()}
    assert rules and all(kept[i] == (not (x >= 8 and y < 6)) for i, x, y in rows)
    assert quality.learn(stats, labels.where("quality = 1"), ("x", "y")) == []
    assert quality.learn(stats.limit(0), labels, ("x", "y")) == []


def test_quality_rules_of_a_rare_kind(spark):
    rows = [(i, 0.0 if i % 50 > 1 else 0.1 + i / 30000 if i % 50 else 0.6 + i / 30000) for i in range(3000)]
    stats = spark.createDataFrame(rows, "doc_id long, x double")
    labels = spark.createDataFrame([(i, int(x < 0.5)) for i, x in rows], "doc_id long, quality int")
    rules = quality.learn(stats, labels, ("x",))
    dropped = {r["doc_id"] for r in stats.where(~quality.verdict(rules)).collect()}
    low = {i for i, x in rows if x >= 0.5}
    assert dropped <= low and len(dropped) >= 0.9 * len(low)


def test_quality_keeps_clean_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [r for r in queries_native.op8(spark, FOLDER).collect() if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in rows) >= 0.97 * len(rows)


def test_raking_meets_its_margins(spark):
    cells = spark.createDataFrame([("a", "en", 90), ("a", "de", 5), ("b", "en", 20), ("b", "de", 60), ("c", "fr", 0)], "source string, lang string, n long")
    raked = mixing.rake(cells, {"source": {"a": 0.5, "b": 0.4}, "lang": {"en": 0.3, "de": 0.6}}, rounds=60).collect()
    assert math.isclose(sum(r["weight"] for r in raked if r["source"] == "a"), 0.5 / 0.9 * 1.0, abs_tol=0.2)
    assert math.isclose(sum(r["weight"] for r in raked if r["lang"] == "de"), 0.6 / 0.9, abs_tol=1e-6)


def test_sampling_spends_the_budget(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    spent, total = sum(r["probability"] * r["n_tokens"] for r in rows), sum(r["n_tokens"] for r in rows)
    assert math.isclose(spent, mixing.BUDGET * total, rel_tol=1e-9) and all(0 <= r["probability"] <= 1 for r in rows)
    drawn = {r["doc_id"] for r in rows if r["sampled"]}
    assert {r["doc_id"] for r in mixing.sample(docs).collect()} == drawn


def test_held_out_rows_are_never_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    used, marks = zip(*((r["text"], r["toxic"]) for r in toxicity.training_sample(docs, labels).collect()), strict=True)
    held = [r["text"] for r in docs.where(toxicity.held_out(docs["doc_id"])).collect()]
    free = Counter(r["text"] for r in docs.where(~toxicity.held_out(docs["doc_id"])).collect())
    assert used and not Counter(used) - free and len(used) == len(marks) and held
