"""Toxicity, secrets, token counts, encodings and fingerprints against brute force on small texts."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash

from articleflow.llm import automaton, encode, grammar, packing, secrets, simhash, simple8b, toxicity, transducer

RULES = {
    0: (re.compile(
        "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        "|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 6),
    1: (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    2: (re.compile("[0-9a-f]+"), 0, 24),
}


def brute_spans(text):
    return sorted(
        (m.start(), kind, m.end()) for kind, (rule, group, least) in RULES.items() for m in rule.finditer(text) if len(m[group]) >= least
    )


def test_secret_spans_equal_a_search_per_rule():
    random.seed(5)
    pieces = ["password", "token", "secret", "apikey", "API_Key", ":", "=", '"', " ", "'", "abc", "AKIA", "ABCDEF123456",
              "0123456789abcdef", "deadbeef", "é", "😀", "\n", "-", "."]
    scanner = secrets.default_scanner()
    for _ in range(4000):
        text = "".join(random.choice(pieces) for _ in range(random.randint(0, 14)))
        assert [s for s in scanner.spans(text) if s[1] < 3] == brute_spans(text), text


def test_further_rules_and_masks():
    text = "é gh" + "p_" + "a1B2" * 9 + " end"
    assert [(s[0], s[2]) for s in secrets.default_scanner().spans(text)] == [(2, 42)]
    assert secrets.mask("my password=hunter22, ok") == "my [assign], ok"
    assert secrets.mask(None) is None and secrets.mask("") == ""


def test_automaton_is_minimal():
    rows = automaton.compile_all([automaton.alt(automaton.word("ab"), automaton.word("cb"))], anywhere=False)
    assert len(rows) == 4  # start, after a or c, end, dead


def test_grammar_scores_clauses():
    table = grammar.toxic_clauses()
    kinds = grammar.INPUT.index

    def found(*words):
        counts = [0] * len(grammar.FINDINGS)
        table.run([kinds(w) for w in words], counts)
        return [name for name, n in zip(grammar.FINDINGS, counts, strict=True) for _ in range(n)]

    assert found("other", "insult") == ["insult"]
    assert found("target", "other", "insult") == ["aimed_insult"]
    assert found("negation", "other", "insult") == ["negated_insult"]
    assert found("report", "target", "insult") == ["reported_insult"]
    assert found("modal", "violence") == ["threat"] and found("violence") == []
    assert found("target", "modal", "violence") == ["aimed_threat"]
    assert found("negation", "modal", "violence") == ["softened_threat"]
    assert found("report", "end", "insult") == ["insult"]
    assert found("insult", "target") == ["insult", "named_after"]


def test_toxicity_learns_stems_but_not_chance_words():
    random.seed(3)
    word = lambda: "".join(random.choice("bcdfg") + random.choice("aeiou") for _ in range(3))
    texts, labels = [], []
    for i in range(400):
        words = [word() for _ in range(30)]
        if i % 4 == 0:
            words[7] = "zorx" + word()
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.learn(texts, labels)
    assert {s[:4] for s in model.stems} == {"zorx"}
    score = lambda t: model.score(model.counts(t))
    assert score("baba zorxbaba baba") > 0.3 > score("baba bebe") and 0 <= score("") < 0.3
    assert toxicity.learn(["a"], [1]) == toxicity.Model()


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return transducer.Counter(transducer.Vocabulary.from_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def test_token_counts_equal_the_library(pieces):
    counter, library = pieces
    random.seed(2)
    parts = ["the", "  ", " ", "a", "b", "\n", "é", "▁", "😀", "ing", "tion", "<s>", "<unk>", "<0x0A>", "中", "\t", "12", ".", "\0", "ß"]
    vocabulary = sorted(counter.vocabulary.scores)
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    texts += ["".join(random.choice(vocabulary).replace("▁", " ") for _ in range(3)) for _ in range(3000)]
    for text in texts:
        assert counter.count(text, random.choice([1, 2, 7, 1000])) == len(library.encode(text)), text


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(name, blanks):
    encoder = encode.Encoder(public_tokenizers.path(name), blanks)
    random.seed(3)
    parts = ["the", "The", " ", " a", "b.", "\n", "é", "é", "́", "😀", "ing", "<|endoftext|>", "'s", "'", "\t", "12", ".", "\xa0", "\x1c", "İ", "!!", "x###", ",$%", "<|ENDOFTEXT|>", "<|", "É", "Σ"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 9)))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, text


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_forgets_and_keeps_no_long_words(name, blanks, monkeypatch):
    monkeypatch.setattr(encode, "MAX_BYTES", 2000)
    monkeypatch.setattr(encode, "CHUNK_CHARS", 300)
    encoder = encode.Encoder(public_tokenizers.path(name), blanks)
    random.seed(5)
    words = ["word", "Ähre,", "x" * 200, "é" * 90 + "!!", "1" * 100, "a.b", *("".join(random.choices("abcé", k=6)) for _ in range(200))]
    texts = ["", *(" ".join(random.choices(words, k=random.randint(1, 40))) for _ in range(200)), "", "  two  blanks ", "\n"]
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_all(texts)]
        assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, encoder.slots)) <= encode.LONGEST_KEPT and len(encoder.slots) < 60


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 60, 61, 1000):
        for top in (1, 2, 300, 50_000, 1 << 31, 1 << 63):
            ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            words, exceptions = simple8b.encode_words(ids)
            assert (simple8b.decode_words(words, exceptions) == ids).all()
    words, _ = simple8b.encode_words(np.zeros(600, np.uint64))
    assert len(words) == 10


def test_packing_fills_every_sequence():
    random.seed(4)
    for total in (0, 1, 30, 300):
        given = [packing.Piece(i, 0, 0, bytes(4 * random.randint(1, 63))) for i in range(total)]
        packed = packing.pack(given, 64)
        lengths = [sum(map(len, s)) for s in packed]
        assert sum(lengths) == sum(map(len, given)) and all(n == 64 or n & (n - 1) == 0 for n in lengths)
        by_doc = {}
        for piece in sorted((p for s in packed for p in s), key=lambda p: (p.doc, p.start)):
            assert piece.start == by_doc.get(piece.doc, 0)
            by_doc[piece.doc] = piece.start + len(piece)
        assert by_doc == {p.doc: len(p) for p in given}
        full = [sum(packing.cost(len(p)) for p in s) for s, n in zip(packed, lengths, strict=True) if n == 64]
        assert not full or max(full) <= 2 * packing.cost(64)


def test_packing_cuts_only_what_fits_nowhere():
    random.seed(6)
    given = [packing.Piece(i, 0, 0, bytes(4 * random.randint(1, 1023))) for i in range(600)]
    packed = packing.pack(given, 1024)
    room, cuts = packing.rooms(sum(map(len, given)), 1024), 0
    spent = [0.0] * len(room)
    for n in sorted(map(len, given), reverse=True):
        while n:
            fits = [i for i, r in enumerate(room) if r >= n]
            at = min(fits or [i for i, r in enumerate(room) if r], key=lambda i: (spent[i], i))
            part = min(n, room[at])
            n, room[at], spent[at], cuts = n - part, room[at] - part, spent[at] + packing.cost(part), cuts + (part < n)
    assert sum(map(len, packed)) == len(given) + cuts


def brute_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints():
    for text in ("", " \n", "One", "a B c", "Äpfel ÉTÉ und\tBirnen\x0bim  Korb\n am Abend", "x " * 50):
        assert simhash.fingerprint(text) == brute_fingerprint(text)
        assert simhash.fingerprint(text, 5) == brute_fingerprint(text, 5)


def test_forest_connects_all_links():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 8)]))
    u, v = simhash._forest(values, values, 4, True)
    parent = {int(x): int(x) for x in values}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u, v, strict=True):
        parent[top(int(a))] = top(int(b))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    for i, j in zip(*np.nonzero(near), strict=True):
        assert top(int(values[i])) == top(int(values[j]))
