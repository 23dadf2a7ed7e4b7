"""Grouping of spelling variants: words one edit apart, found by k-d trees over their letter counts.

Words are counted inside tasks and then summed. The vocabulary is cut into cells: a length, and leaves of a tree
learned on a bounded sample of the vocabulary; a leaf beyond its size is cut by a hash. A word goes as a point to
its own cell, and as a question to every cell whose box is near enough, of its length and of the next one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import map_texts, staged
from articleflow.llm.letter_tree import Node, Points, grow, leaves_near, letter_counts, spelled

LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
#: One run in so many loses a letter, to give the vocabulary variants whose origin is known.
DROP_ONE_IN = 199
#: Words of the sample that top trees are grown on; it alone reaches the driver.
SAMPLE_WORDS = 20_000
#: Words and bytes of a cell, about; and of the counts that a task holds before it hands them on.
CELL_WORDS, CELL_BYTES = 8192, 32 << 20
HELD_BYTES = 32 << 20
#: Letters become their lower case, all other characters blanks.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters up to U+00FF in Latin-1, with only A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def altered(doc: object, run: bytes) -> bytes:
    """The run, or what is left of it when its hash with the document says that it loses a letter; a null id is ``null``."""
    spelled_out = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(spelled_out, zlib.crc32(f"{'null' if doc is None else doc}:".encode()))
    if h % DROP_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: words of enough letters that occur often enough in all whole texts. Null texts have none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(r for r in runs(text or "") if len(r) >= LEAST_LETTERS)
                for run, n in found.items():
                    word = altered(doc, run)
                    if len(word) >= LEAST_LETTERS:
                        if word not in held:
                            size += len(word) + 100
                        held[word] += n
                if size > HELD_BYTES:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    parts = documents.select("doc_id", "text").mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def top_trees(words: DataFrame) -> dict[int, Node]:
    """A tree for every length with more than a cell's words, grown on the sample."""
    sizes = {r["length"]: r["count"] for r in words.groupBy("length").count().where(F.col("count") > CELL_WORDS).toLocalIterator()}
    if not sizes:
        return {}
    sample = words.where(F.col("length").isin(*sizes)).orderBy(F.xxhash64("word")).limit(SAMPLE_WORDS).select("word").toArrow()["word"].to_pylist()
    trees = {}
    for length, size in sizes.items():
        mine = [w.encode("latin-1") for w in sample if len(w) == length]
        share = len(mine) * CELL_WORDS // size
        trees[length] = grow(letter_counts(spelled(mine, length)), max(1, share), 8)[0] if mine else Node()
    return trees


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, their letters)."""
    words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    lengths = np.array(list(map(len, words)))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield length, at, spelled([words[i] for i in at], length)


def placed(words: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """``words`` with the leaf they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf_of = np.zeros(batch.num_rows, np.int64)
            for length, at, letters in _by_length(batch):
                if length in trees:
                    row, leaf = leaves_near(trees[length], letter_counts(letters), 0)
                    leaf_of[at[row]] = leaf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of)], names=[*batch.schema.names, "leaf"])

    return words.mapInArrow(run, "word string, n long, length int, leaf long")


def routed(words: DataFrame, trees: dict[int, Node], pieces: dict[tuple[int, int], int]) -> DataFrame:
    """length, leaf, piece, role, word, n: role 0 is the point in its cell, 1 a question from another cell of the same
    length (each pair of cells once), 2 one from words that are one letter shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, whole = batch.column("leaf").to_numpy(), batch.column("piece").to_numpy()
            parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

            def send(at: np.ndarray, length: int, leaf: np.ndarray, role: int, from_piece: np.ndarray) -> None:
                """To all pieces of the leaves, from a piece on."""
                count = np.array([pieces.get((length, x), 1) for x in leaf.tolist()], np.int64) - from_piece
                count = np.maximum(count, 0)
                i = np.repeat(np.arange(len(at)), count)
                step = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                parts.append((at[i], np.full(len(i), length), leaf[i], from_piece[i] + step, np.full(len(i), role)))

            every = np.arange(batch.num_rows)
            lengths = batch.column("length").to_numpy()
            parts.append((every, lengths.astype(np.int64), own, whole, np.zeros(len(every), np.int64)))
            for length, at, letters in _by_length(batch):
                counts = letter_counts(letters)
                send(at, length, own[at], 1, whole[at] + 1)
                if length in trees:
                    row, leaf = leaves_near(trees[length], counts, 2)
                    later = leaf > own[at[row]]
                    send(at[row[later]], length, leaf[later], 1, np.zeros(later.sum(), np.int64))
                row, leaf = leaves_near(trees[length + 1], counts, 1) if length + 1 in trees else (np.arange(len(at)), np.zeros(len(at), np.int64))
                send(at[row], length + 1, leaf, 2, np.zeros(len(row), np.int64))
            at, *cells = (np.concatenate(x) for x in zip(*parts, strict=True))
            rows = batch.select(["word", "n"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c) for c in cells), *rows.columns], names=["length", "leaf", "piece", "role", "word", "n"]
            )

    return words.mapInArrow(run, "length long, leaf long, piece long, role long, word string, n long")


def _best(words: list[str], n: np.ndarray, row: np.ndarray, other_words: list[str], other_n: np.ndarray, other: np.ndarray) -> list[tuple]:
    """(word, number of near words, the most frequent of them, its count) for rows with near words."""
    rank = np.empty(len(other_words), np.int64)
    rank[np.argsort(np.array(other_words, object))] = np.arange(len(other_words))
    order = np.lexsort((rank[other], -other_n[other], row))
    row, other = row[order], other[order]
    firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    counts = np.diff(np.append(firsts, len(row)))
    return [(words[r], c, other_words[o], int(other_n[o])) for r, c, o in zip(row[firsts].tolist(), counts.tolist(), other[firsts].tolist(), strict=True)]


def near_words(cells: DataFrame) -> DataFrame:
    """word, n_near, near, near_n: what each cell adds to the near words of a word.

    Rows come sorted by cell, points first; only the points of a cell are held, questions pass by in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, points, tree = None, [], None
        counts = np.zeros(0, np.int64)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "near", "near_n"])

        def within() -> Iterator[pa.RecordBatch]:
            """The points of the cell among themselves."""
            nonlocal tree, counts
            words = [w for w, _ in points]
            tree, counts = Points([w.encode("latin-1") for w in words], int(cell[0])), np.array([n for _, n in points], np.int64)
            for i in range(0, len(words), 4096):
                row, other = tree.near(tree.letters[i : i + 4096])
                yield out(_best(words, counts, row + i, words, counts, other))

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("length", "leaf", "piece", "role")], 1)
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                here, role = tuple(keys[a, :3].tolist()), int(keys[a, 3])
                if here != cell:
                    if cell is not None and tree is None and points:
                        yield from within()
                    cell, points, tree = here, [], None
                if role == 0:
                    points += zip(words[a:b], n[a:b].tolist(), strict=True)
                    continue
                if not points:
                    continue  # a cell without points
                if tree is None:
                    yield from within()
                asked = words[a:b]
                row, other = tree.near(spelled([w.encode("latin-1") for w in asked], len(asked[0])))
                mine = [w for w, _ in points]
                yield out(_best(asked, n[a:b], row, mine, counts, other) + _best(mine, counts, other, asked, n[a:b], row))
        if cell is not None and tree is None and points:
            yield from within()

    return cells.mapInArrow(run, "word string, n_near long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain word, form, form's form.

    Counts grow along a chain, so it ends; every round doubles the steps, and only a count reaches the driver.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        jumped = now.join(step, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved"))
        now = staged(jumped, "spelling-roots")
        if not now.where("_moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary.

    Near words differ by one inserted, deleted or replaced letter. A word's form is its most frequent near word, the
    smallest of equal ones, if that is at least ``FACTOR`` times as frequent; its root is the last of its forms.
    Null and empty texts have no words, repeated rows count again, an empty table gives no rows; columns other than
    doc_id and text are not read. Words of any length are compared whole.
    """
    words = staged(vocabulary(documents).withColumn("length", F.length("word")), "spelling-words")
    trees = top_trees(words)
    located = staged(placed(words, trees), "spelling-leaves")
    need = F.greatest(F.ceil(F.count(F.lit(1)) / (2 * CELL_WORDS)), F.ceil(F.sum("length") / CELL_BYTES))
    large = located.groupBy("length", "leaf").agg(need.cast("long").alias("pieces")).where("pieces > 1")
    pieces = {(r["length"], r["leaf"]): r["pieces"] for r in large.toLocalIterator()}
    cut = F.lit(1)
    if pieces:
        given = F.create_map(*(F.lit(x) for (a, b), p in pieces.items() for x in (f"{a}:{b}", p)))
        cut = F.coalesce(given[F.concat_ws(":", "length", "leaf")], F.lit(1))
    located = located.withColumn("piece", F.pmod(F.xxhash64("word"), cut).cast("long"))
    cells = routed(located, trees, pieces).repartition("length", "leaf", "piece").sortWithinPartitions("length", "leaf", "piece", "role")
    found = near_words(cells).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("_best")
    )
    form_n = -F.col("_best.less")
    good = form_n >= FACTOR * F.col("n")
    judged = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("_best.near")).alias("form"), F.when(good, form_n).alias("form_n"),
    )
    judged = staged(judged, "spelling-forms")
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
