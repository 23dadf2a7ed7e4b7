"""Toxicity of whole texts: a weighted grammar of word classes, run clause by clause.

Words become classes (insult, violence, modal, target, negation, report). Five composed transducers
turn the classes of a clause into findings such as an aimed insult, a reported one or a threat.
Findings are weighted; labels adjust the weights and add words and word stems to the insult class.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.llm import grammar
from articleflow.llm.common import map_texts

#: Seed words of the classes.
INSULTS = """idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns
imbecile dumb fool fools bastard jerk crap idiota estúpido imbécil basura connard crétin débile ordure
trottel dummkopf abschaum versager""".split()
VIOLENCE = "kill hurt beat stab shoot strangle destroy smash töten umbringen tuer frapper matar golpear".split()
MODALS = "will gonna shall must should werde werden wirst vais allons voy vamos ll".split()
TARGETS = "you your yourself he she they them him her these those du dich ihr sie tu toi vous ellos tú usted".split()
NEGATIONS = "not never no isn aren wasn don doesn nicht kein keine nie pas jamais ne nunca jamás".split()
REPORTS = "said says say wrote called claims claimed told quoted sagte schrieb dit écrit dijo escribió".split()
#: Weights before any label is seen, in the order of ``grammar.FINDINGS``.
PRIOR_BIAS = -4.0
PRIOR_WEIGHTS = (4.0, 5.0, 1.0, 1.5, 4.0, 6.0, 1.0, 0.5)
#: Bounds of the training sample: rows per label, and characters of a text; one task learns from it.
SAMPLE_TOXIC = 2500
SAMPLE_CLEAN = 4000
SAMPLE_CHARS = 1 << 16

SKETCH_BITS = 22

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;\n]+")


@dataclass(frozen=True)
class Model:
    words: frozenset[str] = frozenset(INSULTS)
    stems: frozenset[str] = frozenset()
    bias: float = PRIOR_BIAS
    weights: tuple[float, ...] = PRIOR_WEIGHTS
    table: grammar.Table = field(default_factory=grammar.toxic_clauses)

    @cached_property
    def classes(self) -> dict[str, int]:
        known: dict[str, int] = {}
        for name, words in (
            ("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("modal", MODALS),
            ("violence", VIOLENCE), ("insult", self.words),
        ):
            known |= dict.fromkeys(words, grammar.INPUT.index(name))
        return known

    @cached_property
    def triggers(self) -> re.Pattern:
        """Finds clauses that can hold a finding; all others score nothing."""
        whole = "|".join(sorted(map(re.escape, {*self.words, *VIOLENCE})))
        stems = "|".join(sorted(map(re.escape, self.stems)))
        stems = f"|(?:{stems})[^\\W\\d_]*" if stems else ""
        return re.compile(rf"(?<![^\W\d_])(?:(?:{whole})(?![^\W\d_]){stems})")

    def symbol(self, word: str) -> int:
        found = self.classes.get(word, 0)
        if not found and any(word[:n] in self.stems for n in range(3, 8)):
            return 1
        return found

    def counts(self, text: str) -> list[int]:
        """How often each finding occurs in a text."""
        counts = [0] * len(grammar.FINDINGS)
        low = text.lower()
        if self.triggers.search(low):
            for clause in _CLAUSE.split(low):
                if self.triggers.search(clause):
                    self.table.run([self.symbol(w) for w in _WORD.findall(clause)], counts)
        return counts

    def score(self, counts: list[int]) -> float:
        z = self.bias + sum(w * math.log2(1 + n) for w, n in zip(self.weights, counts, strict=True) if n)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _signature(words: list[str]) -> int:
    """One min-hash over five-word shingles; near copies count once when words are learned."""
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def _keys(words: set[str]) -> set[str]:
    """Whole words (marked) and stems of four to seven letters."""
    return {f"{w}$" for w in words} | {w[:n] for w in words for n in (4, 5, 6, 7) if len(w) >= n}


def _slot(key: str) -> int:
    return zlib.crc32(key.encode()) & (1 << SKETCH_BITS) - 1


def learn_words(
    texts: list[str], labels: list[int], known: set[str] = frozenset(), least_ratio: float = 20.0
) -> tuple[set[str], set[str]]:
    """Words and stems that mark toxic texts: found on one half of the texts, kept where they hold on the other half.

    Near copies count once. A word holds if it is half of ``least_ratio`` times as frequent in toxic texts there, too:
    syllables that met one label by chance do not.
    """
    groups: tuple[list[set[str]], list[set[str]]] = ([], [])
    seen: set[tuple[int, int]] = set()
    for text, label in zip(texts, labels, strict=True):
        words = _WORD.findall(text.lower())
        mark = (_signature(words), label)
        if mark not in seen:
            seen.add(mark)
            groups[label].append(set(words))
    clean, toxic = ([g[0::2], g[1::2]] for g in groups)
    words, stems = _cover((clean[0], toxic[0]), known, least_ratio)
    wanted = {f"{w}$" for w in words} | stems
    shown = [Counter(k for w in part for k in wanted & _keys(w)) for part in (clean[1], toxic[1])]

    def holds(key: str) -> bool:
        return 2 * (shown[1][key] + 0.5) / (len(toxic[1]) + 1) >= least_ratio * (shown[0][key] + 0.5) / (len(clean[1]) + 1)

    return {w for w in words if holds(f"{w}$")}, {s for s in stems if holds(s)}


def _cover(groups: tuple[list[set[str]], list[set[str]]], known: set[str], least_ratio: float) -> tuple[set[str], set[str]]:
    """A greedy cover of the toxic texts (sets of words) without a ``known`` word.

    A candidate must be ``least_ratio`` times as frequent in toxic texts as in clean ones; each one
    taken must explain enough different texts that no earlier one explains. Stems have four to seven letters.
    """
    sizes = [len(g) for g in groups]
    least = max(10, sizes[1] // 100)
    # counts by a hash of the key first: a table of fixed size tells which few keys are worth a set of their own
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    for text in groups[1]:
        sketch[list({_slot(k) for k in _keys(text)})] += 1
    toxic, clean = defaultdict(set), Counter()
    for n, text in enumerate(groups[1]):
        for k in _keys(text):
            if sketch[_slot(k)] >= least:
                toxic[k].add(n)
    toxic = {k: docs for k, docs in toxic.items() if len(docs) >= least or k.rstrip("$") in known}
    for text in groups[0]:
        clean.update(k for k in _keys(text) if k in toxic)
    open_sets = {
        k: docs for k, docs in toxic.items()
        if len(docs) >= least
        and (len(docs) + 0.5) / (sizes[1] + 1) >= least_ratio * (clean[k] + 0.5) / (sizes[0] + 1)
    }
    words, stems = set(), set()
    covered = set().union(*(toxic[f"{w}$"] for w in known if f"{w}$" in toxic))
    while open_sets:
        best = max(open_sets, key=lambda k: (len(open_sets[k] - covered), len(open_sets[k]), len(k.rstrip("$")), k))
        if len(open_sets[best] - covered) < least:
            break
        covered |= open_sets.pop(best)
        (words if best.endswith("$") else stems).add(best.rstrip("$"))
    return words, stems


def learn(texts: list[str], labels: list[int], steps: int = 30, hold: float = 1.0) -> Model:
    """The grammar with words and weights adjusted to labelled texts; without both labels, as it stands.

    Weights are the maximum of a logistic likelihood with a normal prior around the fixed ones.
    """
    if len(set(labels)) < 2:
        return Model()
    shown = {0: Counter(), 1: Counter()}
    for text, label in zip(texts, labels, strict=True):
        shown[label].update(set(INSULTS) & set(_WORD.findall(text.lower())))
    trusted = {w for w in INSULTS if shown[0][w] < 3 or shown[1][w] > shown[0][w]}
    words, stems = learn_words(texts, labels, trusted)
    model = Model(frozenset(trusted | words), frozenset(stems))
    x = np.log2(1 + np.array([model.counts(t) for t in texts], float))
    x = np.hstack([np.ones((len(x), 1)), x])
    y = np.array(labels, float)
    prior = np.array([PRIOR_BIAS, *PRIOR_WEIGHTS])
    beta = prior.copy()
    for _ in range(steps):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - hold * (beta - prior)
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + hold * np.eye(len(beta))
        move = np.linalg.solve(bend, slope)
        beta = beta + move / max(1.0, float(np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return Model(model.words, model.stems, float(beta[0]), tuple(map(float, beta[1:])))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(documents: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """text, toxic: at most ``toxic`` and ``clean`` labelled rows, the first by a hash of their id, outside the held-out rows.

    Rows without id or label are skipped; the largest of several labels of an id holds, and the smallest of its
    texts. Texts beyond ``SAMPLE_CHARS`` are not learned from, so the sample is bounded in rows and in characters.
    """
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    mixed = F.xxhash64(F.col("doc_id").cast("string"))
    picked = None
    for label, most in ((1, toxic), (0, clean)):
        part = known.where(F.col("toxic") == label).orderBy(mixed, "doc_id").limit(most)
        picked = part if picked is None else picked.unionAll(part)
    short = documents.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    return short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of the bounded sample, learned inside one task: only the model reaches the driver."""
    sample = training_sample(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["text"]))
        model = learn([r["text"] for r in rows], [r["toxic"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], names=["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found is not None else Model()


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and how many findings its text holds.

    Whole texts are scored; null and empty texts get the score of a text without findings. Repeated
    rows are scored one by one, other columns are not read.
    """
    ddl = "doc_id long, score double, predicted int, findings long"

    def rows(keys: list, texts: list) -> dict[str, list]:
        counts = [model.counts(t) for t in texts]
        scores = [model.score(c) for c in counts]
        return {
            "doc_id": keys, "score": scores, "predicted": [int(s >= threshold) for s in scores],
            "findings": [sum(c) for c in counts],
        }

    scored = map_texts(documents, "doc_id", "text", ddl, rows)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "findings")
