"""SimHash near duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles.

Fingerprints of equal bits meet first. Distinct ones are cut into tiles by the population counts of their
halves (of their quarters when there are many); the counts of two fingerprints differ by no more than their
bits do, so tile pairs whose counts differ beyond the radius are never formed. Inside a tile pair numpy compares everything with exclusive-or
and bit counts, and returns a spanning forest of the links in place of all of them.

``one_of_each`` keeps one document of each group. It links what the fingerprints link, and after that, exactly, whole shingle
sets that are alike: found by a fifth of their shingles, rare ones first. Without a radius it compares the sets alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.llm.common import map_texts, staged

SEED = 42
#: Distinct fingerprints in a tile, about; larger cells are cut by a hash.
TILE_ROWS = 1024
#: From so many distinct fingerprints on, quarters give tiles enough rows. Either way finds the same links.
QUARTERS_FROM = 4_000_000
BLOCK = 512
#: Shingle sets are near copies from this similarity on (common over all), as a fraction.
ALIKE = (4, 5)
#: Shingles in a tile of sets, about.
TILE_SHINGLES = 1 << 17
#: Rows of ids and hashes that a broadcast may hold: about 16 MB.
SENT_ROWS = 1 << 19
#: Slots of the sketch of shingle counts, and slices that it is added in, as powers of two.
SKETCH_BITS, SLICE_BITS = 17, 4
#: A slot is hot from so many shingles on, and from so many times the mean.
HOT_LEAST, HOT_TIMES = 512, 8


def fingerprint(text: str, width: int = 4) -> int:
    """A bit is set if more than half of the shingles' hashes have it; repeated shingles count each time."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    last = min(width, len(words))
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts[:n], starts[last : last + n], strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, its fingerprint and its text's hash (as Spark's ``xxhash64``), both signed; null and empty texts have fingerprint zero."""

    def signed(numbers: Iterator[int]) -> list[int]:
        return np.array(list(numbers), np.uint64).view(np.int64).tolist()

    def rows(keys: list, texts: list) -> dict[str, list]:
        return {
            "doc_id": keys, "mark": signed(fingerprint(t, width) for t in texts),
            "text_hash": signed(xxhash.xxh64_intdigest(t.encode(), SEED) for t in texts),
        }

    return map_texts(documents, "doc_id", "text", "doc_id long, mark long, text_hash long", rows)


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) of all that have a link in a tile pair."""
    values = a if same else np.concatenate([a, b])
    offset = 0 if same else len(a)
    label = np.arange(len(values))

    def settle() -> None:
        while True:
            above = label[label]
            if (above == label).all():
                return
            label[:] = above

    linked = np.zeros(len(values), bool)
    for i in range(0, len(a), BLOCK):
        near = np.bitwise_count(a[i : i + BLOCK, None] ^ b[None, :]) <= radius
        x, y = np.nonzero(near)
        x, y = x + i, y + offset
        if same:
            x, y = x[x < y], y[x < y]
        linked[x] = linked[y] = True
        while len(x):  # hook larger roots to smaller ones until both ends of every link agree
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            np.minimum.at(label, high, low)
            settle()
            open_links = label[x] != label[y]
            x, y = x[open_links], y[open_links]
    at = np.flatnonzero(linked & (label != np.arange(len(values))))
    return values[at], values[label[at]]


def _cell(mark: Column, parts: int) -> list[Column]:
    """Population counts of equal parts of a fingerprint."""
    bits = 64 // parts
    ones = F.lit((1 << bits) - 1).cast("long")
    return [F.bit_count(F.shiftrightunsigned(mark, bits * i).bitwiseAND(ones)).alias(f"_p{i}") for i in range(parts)]


def links(marks: DataFrame, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints, enough to connect all within ``radius`` bits of each other.

    ``marks`` has one column, mark. Cells that could hold a link are found by their counts, never by
    multiplying the tables; a cell of many rows is several tiles.
    """
    single = staged(marks.select("mark").where("mark is not null").distinct(), "simhash-single")
    parts = 4 if single.count() >= QUARTERS_FROM else 2
    cells = [f"_p{i}" for i in range(parts)]
    distinct = single.select("mark", *_cell(F.col("mark"), parts))
    sizes = distinct.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_cuts"))
    tiles = (
        distinct.join(sizes, cells)
        .withColumn("_cut", F.pmod(F.xxhash64("mark"), F.col("_cuts")).cast("int"))
        .groupBy(*cells, "_cut").agg(F.collect_list("mark").alias("marks"))
    )
    tiles = staged(tiles.withColumn("tile", F.concat_ws("-", *cells, "_cut")), "simhash-tiles")
    # each unordered pair of cells once: the offset whose first non-zero entry is positive, or none at all
    steps = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius and d >= (0,) * parts]
    offsets = F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"d{i}") for i, x in enumerate(d))) for d in steps))).alias("d")
    narrow = tiles.select(*cells, "_cut", "tile")
    left = narrow.select("*", offsets).select(
        F.col("tile").alias("left_tile"), F.col("_cut").alias("left_cut"),
        *((F.col(c) + F.col(f"d.d{i}")).alias(c) for i, c in enumerate(cells)),
        F.expr(" and ".join(f"d.d{i} = 0" for i in range(parts))).alias("same_cell"),
    )
    pairs = (
        left.join(narrow.withColumnRenamed("tile", "right_tile"), cells)
        .where(~F.col("same_cell") | (F.col("left_cut") <= F.col("_cut")))
        .select("left_tile", "right_tile")
    )
    blobs = tiles.select("tile", "marks")
    work = (
        pairs.join(blobs.select(F.col("tile").alias("left_tile"), F.col("marks").alias("a")), "left_tile")
        .join(blobs.select(F.col("tile").alias("right_tile"), F.col("marks").alias("b")), "right_tile")
        .select((F.col("left_tile") == F.col("right_tile")).alias("same"), "a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                a, b = (batch.column(k)[i].values.to_numpy().view(np.uint64) for k in (1, 2))
                found.append(_forest(a, b, radius, batch.column(0)[i].as_py()))
            u, v = (np.concatenate(side).view(np.int64) for side in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return work.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link.

    Large and small stars in turn: each node's neighbours move to the smallest node it knows, until stars are
    all that is left. Rounds are written to the shared folder; only a count and a sum reach the driver.
    """
    least, greatest = F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")
    now = staged(edges.where("u <> v").select(greatest, least).distinct(), "stars")
    before = None
    for _ in range(most):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        seen = Observation()
        now = staged(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "stars")
        state = seen.get
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(documents: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), group_id, text_hash.

    Null and empty texts, and texts without words, have fingerprint zero and link like others. Documents
    without an id belong to a component but never name it; ``group_id`` tells components apart also where ids
    repeat. Repeated rows stay; other columns are not read.
    """
    marks = staged(fingerprints(documents, width), "simhash-marks")
    rooted = components(links(marks, radius))
    first = marks.groupBy("mark").agg(F.min("doc_id").alias("first"))
    known = first.join(rooted, F.col("mark") == F.col("node"), "left").select("mark", "first", F.coalesce("root", "mark").alias("root"))
    known = staged(known, "simhash-roots")
    names = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(names, "root").select("mark", "root", "component_id")
    return marks.join(named, "mark").select(
        "doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id",
        F.lower(F.lpad(F.hex("root"), 16, "0")).alias("group_id"), "text_hash",
    )


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; fewer than ``width`` words are one shingle, no words none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return np.unique(mixed.view(np.int64))


def _set_mark(shingles: np.ndarray) -> int:
    """A signed hash that names a shingle set; zero for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64)) if len(shingles) else 0


def _alike_forest(a: tuple[np.ndarray, list], b: tuple[np.ndarray, list], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(mark, root) of all sets with a link in a pair of tiles (marks, shingle sets): exact similarity of ``ALIKE`` or more."""
    marks = a[0] if same else np.concatenate([a[0], b[0]])
    offset = 0 if same else len(a[0])
    sizes = np.array([len(x) for x in b[1]])
    values = np.concatenate(b[1])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    label = np.arange(len(marks))
    for i, x in enumerate(a[1]):
        if (label[offset:] == label[i]).all():
            continue
        low = np.searchsorted(values, x, "left")
        runs = np.searchsorted(values, x, "right") - low
        at = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        common = np.bincount(owners[at], minlength=len(sizes))
        # common / (both - common) >= up / down
        near = (ALIKE[0] + ALIKE[1]) * common >= ALIKE[0] * (len(x) + sizes)
        met = np.append(label[offset:][near], label[i])
        label[np.isin(label, met)] = met.min()
    at = np.flatnonzero(label != np.arange(len(marks)))
    return marks[at], marks[label[at]]


def prefix_length(size: int) -> int:
    """Of two sets alike by ``ALIKE`` and of any fixed order of shingles: so many first ones of each have one in common."""
    up, down = ALIKE
    return size - -(-size * up // down) + 1


def alike_links(sets: DataFrame, prefixes: DataFrame, shingles: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (u, v) between different shingle sets, enough to connect all pairs whose similarity is ``ALIKE`` or more.

    ``sets`` has mark and size, ``prefixes`` mark and token: the first ``prefix_length`` shingles of each set in one fixed
    order. Two sets alike share one of those, so groups joined by them hold every pair. Inside a group sets are
    compared exactly, in tiles of bounded bytes; ``shingles(wanted)`` gives mark and shingles of the marks in ``wanted``.
    """
    least = prefixes.groupBy("token").agg(F.min("mark").alias("v"), F.max("mark").alias("_w")).where("v < _w").drop("_w")
    shared = staged(least, "alike-shared")  # few of the shingles, so the join may send them to all tasks
    groups = components(prefixes.join(shared, "token").select(F.col("mark").alias("u"), "v"))
    members = staged(groups.withColumnRenamed("node", "mark").join(sets, "mark"), "alike-members")
    cuts = members.groupBy("root").agg(F.ceil(F.sum("size") / TILE_SHINGLES).cast("int").alias("_cuts"))
    cuts = staged(cuts, "alike-cuts")
    placed = members.join(cuts, "root").select("mark", "root", F.pmod(F.xxhash64("mark"), F.col("_cuts")).cast("int").alias("cut"))
    tiles = staged(
        shingles(members.select("mark")).join(placed, "mark").groupBy("root", "cut").agg(F.collect_list(F.struct("mark", "shingles")).alias("sets")),
        "alike-tiles",
    )
    pairs = cuts.select("root", "_cuts", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("left")).select(
        "root", "left", F.explode(F.sequence(F.col("left"), F.col("_cuts") - 1)).alias("right")
    )
    work = (
        pairs.join(tiles.select("root", F.col("cut").alias("left"), F.col("sets").alias("a")), ["root", "left"])
        .join(tiles.select("root", F.col("cut").alias("right"), F.col("sets").alias("b")), ["root", "right"])
        .select((F.col("left") == F.col("right")).alias("same"), "a", "b")
    )

    def tile(sets: pa.Array) -> tuple[np.ndarray, list]:
        lists = sets.field("shingles")
        return sets.field("mark").to_numpy(), [lists[i].values.to_numpy() for i in range(len(lists))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (tile(batch.column(k)[i].values) for k in (1, 2))
                u, v = _alike_forest(a, b, batch.column(0)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return work.mapInArrow(run, "u long, v long")


def _if_small(rows: DataFrame) -> DataFrame:
    """Up to ``SENT_ROWS`` rows of three numbers are sent to all tasks, so that texts stay where they are; more are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def _measured_sets(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, mark, size, text_hash of every row, and from every task a sketch of how many of its texts hold a shingle.

    A sketch is a table of fixed size over hashes; its slices have rows of their own (slice, counts).
    """
    rows = 1 << SKETCH_BITS - SLICE_BITS
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "mark", "size", "text_hash", "slice")] + [("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            marks, sizes = [], []
            for text in texts:
                shingles = shingle_set(text, width)
                marks.append(_set_mark(shingles))
                sizes.append(len(shingles))
                np.add.at(sketch, _slots(shingles), 1)
            hashes = np.array([xxhash.xxh64_intdigest(t.encode(), SEED) for t in texts], np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(texts), pa.int64()), pa.nulls(len(texts), pa.binary())], schema=schema)
        if sketch.any():
            parts = sketch.reshape(-1, rows)
            blank = [pa.nulls(len(parts), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*blank, pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts])], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, mark long, size long, text_hash long, slice long, counts binary"
    )


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _levels(found: DataFrame) -> np.ndarray:
    """How often shingles of a slot occur in all texts, in powers of the square root of two: a byte a slot, so of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(blob, np.uint32).astype(np.int64)
                sums[k] = sums[k] + counts if k in sums else counts
        if sums:
            levels = [(2 * np.log2(np.maximum(v, 1))).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(levels)], names=["slice", "levels"])

    parts = found.where("slice IS NOT NULL").select("slice", "counts").repartition(1 << SLICE_BITS, "slice").mapInArrow(run, "slice long, levels binary")
    made = np.zeros(1 << SKETCH_BITS, np.uint8)
    rows = 1 << SKETCH_BITS - SLICE_BITS
    for r in parts.toLocalIterator():
        made[r["slice"] * rows : (r["slice"] + 1) * rows] = np.frombuffer(r["levels"], np.uint8)
    return made


def _token(shingles: np.ndarray) -> np.ndarray:
    """Half of a shingle's hash: any function of shingles will do for meeting, and it takes half the room."""
    return (shingles.view(np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _split(shingles: np.ndarray, levels: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that are counted one by one, and the hot ones in their order: by level, then by value."""
    level = levels[_slots(shingles)]
    far = level >= hot
    return shingles[~far], shingles[far][np.argsort(level[far], kind="stable")]


def _counted_tokens(texts: DataFrame, levels: np.ndarray, hot: int, width: int) -> DataFrame:
    """mark, token for (mark, text): the shingles that are not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                tokens = [_token(_split(shingle_set(t or "", width), levels, hot)[0]) for t in part.column(1).to_pylist()]
                owners = np.repeat(part.column(0).to_numpy(), [len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate(tokens))], names=["mark", "token"])

    return texts.select("mark", "text").mapInArrow(run, "mark long, token int")


def _hot_tokens(texts: DataFrame, levels: np.ndarray, hot: int, width: int) -> DataFrame:
    """mark, counted, tokens for (mark, text): how many shingles are not hot, and the hot ones that a prefix needs even so."""

    def rows(keys: list, texts: list) -> dict[str, list]:
        counted, needed = [], []
        for text in texts:
            shingles = shingle_set(text, width)
            plain, far = _split(shingles, levels, hot)
            counted.append(len(plain))
            needed.append(_token(far[: max(0, prefix_length(len(shingles)) - len(plain))]).tolist() if len(shingles) else [])
        return {"mark": keys, "counted": counted, "tokens": needed}

    return map_texts(texts, "mark", "text", "mark long, counted long, tokens array<int>", rows)


def _prefixes(texts: DataFrame, sets: DataFrame, levels: np.ndarray, width: int) -> DataFrame:
    """mark, token: the first shingles of every set in one order, as far as other sets have them.

    Rare ones come first by their exact count. Shingles whose slot of the sketch is far above the mean are hot: they
    come last, by level, and are never gathered, so no shingle's rows fill a task.
    """
    mean = float(np.mean(np.exp2(levels[levels > 0] / 2))) if (levels > 0).any() else 1.0
    hot = int(2 * np.log2(max(HOT_LEAST, HOT_TIMES * mean)))
    far = staged(_hot_tokens(texts, levels, hot, width), "alike-hot")
    listed = _counted_tokens(texts, levels, hot, width)
    shared = listed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("n > 1")
    shared = shared.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("shared"))
    up, down = ALIKE
    first = F.col("size") - F.floor((F.col("size") * up + down - 1) / down) + 1 - (F.col("counted") - F.size("shared"))
    plain = shared.join(sets, "mark").join(far.select("mark", "counted"), "mark").withColumn("_first", first.cast("int"))
    plain = plain.where("_first > 0").select("mark", F.explode(F.slice("shared", F.lit(1), F.col("_first"))["token"]).alias("token"))
    return plain.unionAll(far.select("mark", F.explode("tokens").alias("token")))


def _print_links(documents: DataFrame, found: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) between the shingle sets of texts that ``near_duplicates`` puts in one group; equal texts count once."""
    groups = near_duplicates(documents, radius).select("text_hash", "group_id").distinct()
    members = groups.join(found.select("text_hash", "mark").distinct(), "text_hash").select("group_id", "mark").distinct()
    members = staged(members, "print-members")
    heads = members.groupBy("group_id").agg(F.min("mark").alias("v"), F.max("mark").alias("_w")).where("v < _w").drop("_w")
    return members.join(heads, "group_id").where("mark <> v").select(F.col("mark").alias("u"), "v")


def one_of_each(documents: DataFrame, width: int = 5, radius: int | None = None) -> DataFrame:
    """``documents`` without near duplicates: of each component the row with the smallest doc_id stays.

    With a ``radius``, rows are linked as ``near_duplicates`` does, by fingerprints that differ in so many bits at most.
    Rows are also linked when the sets of their shingles are alike by ``ALIKE`` or more, compared exactly; links chain.
    Texts without words are alike. Of equal ids the row with the smallest text hash stays, of equal texts one; rows
    without an id stay only where their component has no other. Columns and their values are kept as they are.
    """

    found = staged(_measured_sets(documents, width), "shingle-marks")
    levels = _levels(found)
    found = found.where("slice IS NULL").drop("slice", "counts")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    firsts = staged(found.groupBy("mark").agg(F.min(rank).alias("_first"), F.min("size").alias("size")), "shingle-sets")
    # the same id with the same text: only then is it worth moving texts
    repeats = found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    hashed = documents.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        of = firsts.join(wanted.select("mark"), "mark", "left_semi").select("mark", F.col("_first.i").alias("_i"), F.col("_first.h").alias("_h"))
        texts = hashed.select("doc_id", "text", "_hash").join(_if_small(staged(of, "alike-wanted")), same).select("mark", "text")
        return texts.dropDuplicates(["mark"]) if repeats else texts

    def shingles(wanted: DataFrame) -> DataFrame:
        rows = lambda keys, texts: {"mark": keys, "shingles": [shingle_set(t, width) for t in texts]}
        return map_texts(texts_of(wanted), "mark", "text", "mark long, shingles array<long>", rows)

    sets = firsts.where("size > 0").select("mark", "size")
    prefixes = staged(_prefixes(texts_of(sets), sets, levels, width), "alike-prefixes")
    links = alike_links(sets, prefixes, shingles)
    if radius is not None:
        links = links.unionAll(_print_links(documents, found, radius))
    rooted = firsts.join(components(links).withColumnRenamed("node", "mark"), "mark", "left")
    leaders = rooted.groupBy(F.coalesce("root", "mark")).agg(F.min("_first").alias("_first"))
    leaders = staged(leaders.select(F.col("_first.i").alias("_i"), F.col("_first.h").alias("_h")).distinct(), "shingle-leaders")
    kept = hashed.join(_if_small(leaders), same, "left_semi")
    if repeats:
        kept = kept.dropDuplicates(["doc_id", "_hash"])
    return kept.select(documents.columns)
