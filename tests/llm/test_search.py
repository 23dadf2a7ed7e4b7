"""Spelling variants, nearest neighbours and hard negatives against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from articleflow.llm import blocks, letter_tree, multi_index, negatives, registry, spelling
from articleflow.llm.common import table

FOLDER = "/root/testdata/sf0.001"
registry.load()


def brute_words(documents):
    counts = Counter()
    for doc, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    near = {w: set() for w in words}
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        return root(forms[w]) if forms[w] else w

    return {(w, forms[w], root(w), n, len(near[w]), words.get(forms[w])) for w, n in words.items()}


def as_set(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("cell", [None, 100, 20])
def test_spelling_equals_brute_force(spark, monkeypatch, cell):
    """Also with top trees and cut leaves, which the small tables would not need."""
    if cell:
        monkeypatch.setattr(spelling, "CELL_WORDS", cell)
    rows = table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    want = brute_variants(brute_words([tuple(r) for r in rows]))
    got = registry.QUERIES["op11_spelling"](spark, FOLDER)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert as_set(got) == want and any(r[1] for r in want)


def test_spelling_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL_BYTES", 64)
    long = "q" * 70_000
    rows = [(None, "abcdef " * 5, 1), (1, None, 1), (2, "", 1), (3, "Abcdef " * 200 + "abcdefg " * 40 + "bacdef " * 7, 1), (3, "xbcdef " * 6, 1)]
    rows += [(4, f"{long} {long}x " * 5 + "straße ÉTÉÉTÉ ÉTÉÉTÈ 漢abcdeg漢 " * 6, 1), (5, "ab×÷cd " * 5 + "ab×cd÷ " * 5 + "fedcba " * 9, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "word")
    want = brute_variants(brute_words([(r[0], r[1]) for r in rows]))
    assert as_set(spelling.variants(docs)) == want and len(want) >= 8
    assert spelling.variants(docs.limit(0)).collect() == []


def test_tree_finds_all_pairs():
    numbers = np.random.default_rng(3)
    for length, other in ((6, 6), (6, 7), (9, 9)):
        words = [bytes(numbers.choice([*b"abc\xe9"], length).astype(np.uint8)) for _ in range(700)] + [b"abcabcabc"[:length]] * 0
        longer = list({bytes(numbers.choice([*b"abc\xe9"], other).astype(np.uint8)) for _ in range(900)})
        points = letter_tree.Points(longer, other)
        row, at = points.near(letter_tree.spelled(words, length))
        got = set(zip(row.tolist(), at.tolist(), strict=True))
        assert len(got) == len(row)
        assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(longer) if one_edit(a.decode("latin-1"), b.decode("latin-1"))}


def usable(r):
    v = r["embedding"]
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def brute_nearest(rows, k=10):
    dims = max(len(r["embedding"]) for r in rows)
    rows = [r for r in rows if any(r["embedding"])]
    wide = np.array([[*r["embedding"], *[0] * (dims - len(r["embedding"]))] for r in rows], float)
    ids = [r["vec_id"] for r in rows]
    out = []
    for i, q in enumerate(ids):
        if q is not None and q % 100 == 0:
            d = np.sqrt(((wide - wide[i]) ** 2).sum(1))
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (d[j], ids[j] is None, ids[j] or 0))[:k]
            out += [(q, n + 1, ids[j], round(float(d[j]), 9)) for n, j in enumerate(order)]
    return sorted(out, key=str)


def found_nearest(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_neighbours_recall(spark, folder):
    rows = table(spark, folder, "embeddings").collect()
    want, got = brute_nearest(rows), found_nearest(registry.QUERIES["op12_neighbours"](spark, folder))
    true = {(q, v): s for q, _, v, s in want}
    assert len(got) == len(want)
    assert sum((q, v) in true for q, _, v, _ in got) >= 0.9 * len(true)
    every = multi_index.search(table(spark, folder, "embeddings"), table(spark, folder, "embeddings").where("vec_id % 100 = 0"), radius=64)
    assert found_nearest(every) == want


def test_index_retrieves_every_code_within_a_radius():
    numbers = np.random.default_rng(5)
    codes = numbers.integers(0, 1 << 63, 3000, dtype=np.uint64)
    codes[:400] = codes[0] ^ (np.uint64(1) << numbers.integers(0, 64, (400, 9), dtype=np.uint64)).sum(1, dtype=np.uint64)
    orders = np.argsort(multi_index.substrings(codes), axis=0, kind="stable").T
    starts = multi_index.starts_of(codes)
    for radius in (0, 1, 3, 4, 7, 10, 18, 25, 64):
        for code in codes[[0, 5, 999]]:
            got = multi_index.within(code, codes, orders, starts, radius)
            assert got.tolist() == np.flatnonzero(np.bitwise_count(codes ^ code) <= radius).tolist()


ODD = [
    (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [0.9, 0.5], 1), (200, [0.0, 0.0], 1), (300, None, 1), (400, [None, 1.0], 1),
    (500, [float("nan"), 1.0], 2), (None, [1.0, 0.5], 2), (None, [0.2, -3.0, 0.7], 1), (7, [0.9, 0.5], None), (8, [0.9, 0.5], 2), (9, [1.1, 0.4], 2),
    (10, [-1.0, 0.1], 1), (11, [], 1), (600, [float("inf"), 1.0], 1), (700, [2.5, -0.1, 0.3], 2), (12, [1.0, 0.5], 2), (13, [1.0, 0.45], 1), (800, [-0.5, -0.5], 3),
]


def odd_rows(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ODD], "vec_id long, embedding array<double>, label int, row int, part string")


def test_neighbours_edge_cases(spark):
    df = odd_rows(spark)
    rows = [r for r in df.collect() if usable(r)]
    for partitions in (1, 5):
        got = multi_index.search(df.repartition(partitions), df.where("vec_id % 100 = 0"), k=4, radius=64)
        assert found_nearest(got) == brute_nearest(rows, 4)
    assert multi_index.search(df.limit(0), df.limit(0)).collect() == []
    assert multi_index.search(df, df.limit(0)).collect() == []
    alone = df.where("vec_id = 700")
    assert multi_index.search(alone, alone).collect() == []


def brute_negatives(rows, k=5):
    rows = [r for r in rows if r["label"] is not None]
    dims = max(len(r["embedding"]) for r in rows)
    wide = np.array([[*np.floor(256 * np.array(r["embedding"], float)), *[0] * (dims - len(r["embedding"]))] for r in rows]).astype(int)
    ids, labels = [r["vec_id"] for r in rows], [r["label"] for r in rows]
    out = []
    for i, a in enumerate(ids):
        if a is None or a % 100:
            continue
        s = (wide @ wide[i]).tolist()
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j] is None, ids[j] or 0))
        for p in [j for j in order if labels[j] == labels[i]][:k]:
            inside = [j for j in order if labels[j] != labels[i] and 80 * s[p] <= 100 * s[j] <= 100 * s[p]][:k]
            out += [(a, ids[p], n + 1, ids[j], s[p], s[j]) for n, j in enumerate(inside)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [None, 64])
def test_negatives_equal_brute_force(spark, monkeypatch, tile):
    if tile:
        monkeypatch.setattr(blocks, "TILE_ROWS", tile)
        monkeypatch.setattr(blocks, "BLOCK_ROWS", 2)
    rows = [r.asDict() for r in table(spark, FOLDER, "embeddings").collect()]
    for r in rows:
        r["label"] = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
    got = registry.QUERIES["op13_negatives"](spark, FOLDER)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows)


def test_negatives_edge_cases(spark):
    df = odd_rows(spark)
    rows = [r for r in df.collect() if usable(r)]
    got = negatives.mine(df.repartition(3), df.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows) != []
    assert negatives.mine(df.limit(0), df.limit(0)).collect() == []
    with pytest.raises(Exception, match="too large"):
        big = spark.createDataFrame([(100, [1e30], 1)], "vec_id long, embedding array<double>, label int")
        negatives.mine(big, big).collect()


def test_lookups_equal_products():
    numbers = np.random.default_rng(1)
    for dims, most in ((1, 1), (8, 3), (13, 700), (64, 1 << 20)):
        a, b = numbers.integers(-most, most, (5, dims)), numbers.integers(-most, most, (90, dims))
        planes, _ = negatives.bit_planes(b)
        assert (negatives.scores(a, planes) == b @ a.T).all()
