"""Sentence ranking: cosine graph, PageRank per document, selection under a token budget.

The graph joins every pair of sentences of a document, but no pair is ever a row. For sparse
non-negative vectors the similarity matrix is W x transpose(W) with an empty diagonal, so a
PageRank step is two sums over term weights. Dense vectors, whose negative cosines count as 0, are
multiplied block by block, in cells of bounded size. Documents up to a checked size are solved in one Arrow batch each;
larger ones by joins and aggregates, with checkpoints to cut lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

from articleflow.functions.text import est_tokens, once, split_long
from articleflow.session import cut_lineage, staged

DAMPING = 0.85
MAX_ITERATIONS = 100
TOLERANCE = 1e-4
DIGITS = 9
MAX_CELLS = 4_000_000
MAX_SENTENCES = 2_048
BLOCK = 512
#: Strips of a group, about, as long as none is larger than so many rows.
STRIPS, STRIP_ROWS = 8, 16_384
#: Rows of one number each that are sent to all tasks of a step; more are joined by a shuffle.
SENT_ROWS = 1 << 20


def _converge(step: Callable[[np.ndarray], np.ndarray], out: np.ndarray) -> np.ndarray:
    """Power iteration; rows without neighbours pass nothing on."""
    n = len(out)
    safe = np.where(out == 0, 1.0, out)
    score = np.full(n, 1.0 / n)
    for _ in range(MAX_ITERATIONS):
        before = score
        score = DAMPING * step(before / safe) + (1.0 - DAMPING) / n
        if np.abs(score - before).sum() < TOLERANCE:
            break
    return score


def _sparse_scores(size: int, sent: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    if size == 0:
        return np.empty(0)
    order = np.lexsort((term, sent))
    sent, term, weight = sent[order], term[order], weight[order]
    norm = np.sqrt(np.bincount(sent, weight * weight, size))
    cell = weight / np.where(norm == 0, 1e-8, norm)[sent]
    _, term = np.unique(term, return_inverse=True)

    def step(x: np.ndarray) -> np.ndarray:
        own = cell * x[sent]
        others = np.bincount(term, own, term.max() + 1 if len(term) else 0)[term] - own
        return np.bincount(sent, cell * others, size)

    return _converge(step, step(np.ones(size)))


def _dense_scores(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm == 0, 1e-8, norm)
    graph = np.clip(unit @ unit.T, 0.0, None)
    np.fill_diagonal(graph, 0.0)
    return _converge(lambda x: graph @ x, graph.sum(axis=1))


@F.pandas_udf(ArrayType(DoubleType()))
def _sparse_batch(size: pd.Series, sent: pd.Series, term: pd.Series, weight: pd.Series) -> pd.Series:
    return pd.Series([
        _sparse_scores(n, np.asarray(s, "int64"), np.asarray(t, "int64"), np.asarray(w, "float64"))
        for n, s, t, w in zip(size, sent, term, weight)
    ])


@F.pandas_udf(ArrayType(DoubleType()))
def _dense_batch(vectors: pd.Series) -> pd.Series:
    return pd.Series([_dense_scores(np.stack(list(v)).astype("float64")) for v in vectors])


def _large(sizes: DataFrame, key: str, limit: int) -> DataFrame | None:
    """Keys of the documents beyond the limit, or None if there are none."""
    keys = sizes.where(F.col("cells") > limit).select(key)
    return None if keys.isEmpty() else keys


def score_lists(
    vectors: DataFrame,
    docs: DataFrame,
    key: str = "doc_id",
    max_cells: int = MAX_CELLS,
    sizes: DataFrame | None = None,
    name: str = "scores",
) -> DataFrame:
    """Documents with their sentence scores as an array in sentence order.

    ``vectors`` are non-negative and sparse (doc_id, sent_idx, term, weight); ``docs`` has
    (doc_id, sentences, ...) with the number of sentences, numbered from 0. ``sizes`` (doc_id,
    cells) may give an upper bound of each document's vector cells from something cheaper than the
    vectors, such as its length; by default they are counted.
    """
    if sizes is None:
        sizes = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("cells"))
    large = _large(sizes, key, max_cells)
    small = vectors if large is None else vectors.join(large, key, "left_anti")
    grouped = small.groupBy(key).agg(
        F.collect_list("sent_idx").alias("_i"),
        F.collect_list("term").alias("_t"),
        F.collect_list("weight").alias("_w"),
    )
    none = lambda kind: F.array().cast(f"array<{kind}>")
    solved = _sparse_batch(
        F.col("sentences"),
        F.coalesce("_i", none("bigint")),
        F.coalesce("_t", none("int")),
        F.coalesce("_w", none("double")),
    )
    usual = docs if large is None else docs.join(large, key, "left_anti")
    out = usual.join(grouped, key, "left").withColumn(name, solved).drop("_i", "_t", "_w")
    if large is not None:
        big = docs.join(large, key, "left_semi")
        found = joined_scores(vectors.join(large, key, "left_semi"), big.select(key, "sentences"), key)
        ordered = F.array_sort(F.collect_list(F.struct("sent_idx", "score")))
        lists = found.groupBy(key).agg(F.transform(ordered, lambda r: r["score"]).alias(name))
        out = out.unionByName(big.join(lists, key))
    return out.withColumn(name, F.transform(name, lambda s: F.round(s, DIGITS)))


def scores(
    vectors: DataFrame,
    nodes: DataFrame,
    key: str = "doc_id",
    max_cells: int = MAX_CELLS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, sent_idx, score), one row per sentence; see ``score_lists``."""
    listed = score_lists(vectors, nodes.select(key, "sentences"), key, max_cells, sizes)
    return listed.select(key, F.posexplode("scores").alias("sent_idx", "score")).withColumn(
        "sent_idx", F.col("sent_idx").cast("long")
    )


def joined_scores(vectors: DataFrame, nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same scores by joins and aggregates, for documents of any size.

    Terms and sentences spread a large document over all tasks. A document stops at its own
    tolerance; the loop ends when all have stopped.
    """
    at = [key, "sent_idx"]
    norms = vectors.groupBy(*at).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_norm"))
    cells = cut_lineage(
        vectors.join(norms, at).select(
            *at,
            "term",
            (F.col("weight") / F.when(F.col("_norm") == 0, 1e-8).otherwise(F.col("_norm"))).alias("w"),
        )
    )

    def step(x: DataFrame) -> DataFrame:
        """(doc, sentence, z) from (doc, sentence, x)."""
        own = cells.join(x, at).withColumn("own", F.col("w") * F.col("x"))
        per_term = own.groupBy(key, "term").agg(F.sum("own").alias("all"))
        return own.join(per_term, [key, "term"]).groupBy(*at).agg(
            F.sum(F.col("w") * (F.col("all") - F.col("own"))).alias("z")
        )

    sentences = nodes.select(
        key, "sentences", F.explode(F.sequence(F.lit(0), F.col("sentences").cast("int") - 1)).alias("sent_idx")
    ).withColumn("sent_idx", F.col("sent_idx").cast("long"))
    out = step(sentences.select(*at, F.lit(1.0).alias("x"))).withColumnRenamed("z", "out")
    state = sentences.join(out, at, "left").select(
        *at,
        "sentences",
        F.when(F.coalesce("out", F.lit(0.0)) == 0, 1.0).otherwise(F.col("out")).alias("out"),
        (F.lit(1.0) / F.col("sentences")).alias("score"),
        F.lit(False).alias("done"),
    )
    state = cut_lineage(state)
    for _ in range(MAX_ITERATIONS):
        z = step(state.where(~F.col("done")).select(*at, (F.col("score") / F.col("out")).alias("x")))
        fresh = DAMPING * F.coalesce("z", F.lit(0.0)) + (1.0 - DAMPING) / F.col("sentences")
        moved = state.join(z, at, "left").withColumn(
            "_new", F.when(F.col("done"), F.col("score")).otherwise(fresh)
        )
        change = moved.groupBy(key).agg(
            (F.sum(F.abs(F.col("_new") - F.col("score"))) < TOLERANCE).alias("_still")
        )
        state = cut_lineage(
            moved.join(change, key).select(
                *at, "sentences", "out", F.col("_new").alias("score"),
                (F.col("done") | F.col("_still")).alias("done"),
            )
        )
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select(*at, "score")


def unit_blocks(vectors: DataFrame, key: str, item: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(doc, block, strip, strips, ids, vs): about ``block`` unit vectors each, laid end to end in ``vs``.

    A document is cut into as many blocks as its size asks for, whatever its ids look like; ``item`` is unique
    inside it. Rows without a key, an item or a vector take no part. Neighbouring blocks form strips: about
    the root of their number each, or more so that there are no more than ``STRIPS``, at most ``STRIP_ROWS`` rows.
    """
    sizes = vectors.groupBy(F.col(key).alias("doc")).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = vectors.select(
        F.col(key).alias("doc"), F.col(item).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    ).where("doc is not null and id is not null and v is not null")
    norm = F.sqrt(F.reduce("v", F.lit(0.0), lambda s, v: s + v * v))
    safe = F.when(norm == 0, 1e-8).otherwise(norm)
    unit = once(safe, lambda length: F.transform("v", lambda v: v / length))
    placed = rows.withColumn("v", unit).join(sizes, "doc").select(
        "doc", "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.struct("id", "v").alias("_r")
    )
    listed = placed.groupBy("doc", "blocks", "block").agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    width = F.greatest(F.ceil(F.sqrt("blocks")), F.ceil(F.col("blocks") / STRIPS))
    width = F.least(width, F.lit(max(1, STRIP_ROWS // block)).cast("long"))
    return listed.select(
        "doc",
        "block",
        F.floor(F.col("block") / width).alias("strip"),
        F.ceil(F.col("blocks") / width).alias("strips"),
        F.transform("_r", lambda r: r["id"]).alias("ids"),
        F.flatten(F.transform("_r", lambda r: r["v"])).alias("vs"),
    )


def cells(blocks: DataFrame) -> DataFrame:
    """Blocks once for every cell (doc, i, j), i <= j, in which their strip meets another: the unit of work.

    A document of any size is cut into cells of two strips, so a hot one is spread over all tasks, every pair of
    its blocks meets once, and a block is copied as often as there are strips.
    """
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1)).alias("_o")
    return blocks.select("*", met).select(
        *blocks.columns, F.least("strip", "_o").alias("i"), F.greatest("strip", "_o").alias("j")
    )


def _products(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, own: bool) -> tuple[np.ndarray, ...]:
    """Clipped products of two strips, part by part: both sides' weighted sums of similarities, and both sides' neighbours.

    With ``own`` the strips are one: every pair is met once, and both of its rows are in the first side's numbers.
    """
    sums, near = (np.zeros(len(x)), np.zeros(len(y))), (np.zeros(len(x), "int64"), np.zeros(len(y), "int64"))
    for p in range(0, len(x), BLOCK):
        for q in range(p if own else 0, len(y), BLOCK):
            a, b = slice(p, p + BLOCK), slice(q, q + BLOCK)
            graph = np.clip(left[a] @ right[b].T, 0.0, None)
            if own and p == q:
                np.fill_diagonal(graph, 0.0)
            else:
                sums[1][b] += x[a] @ graph
                near[1][b] += (graph > 0).sum(axis=0)
            sums[0][a] += graph @ y[b]
            near[0][a] += (graph > 0).sum(axis=1)
    if own:
        return sums[0] + sums[1], sums[1][:0], near[0] + near[1], near[1][:0]
    return *sums, *near


def _cell(cell: pd.DataFrame) -> pd.DataFrame:
    """Clipped products of one cell: per row, neighbours and the sum of similarities."""
    first, last = cell["i"].iloc[0], cell["j"].iloc[0]
    sides = [cell[cell["strip"] == strip] for strip in (first, last)]
    ids = [np.concatenate([np.asarray(v) for v in side["ids"]] or [np.empty(0, "int64")]) for side in sides]
    left, right = (
        np.concatenate([np.asarray(v) for v in side["vs"]] or [np.empty(0)]).reshape(len(i), -1 if len(i) else 1)
        for side, i in zip(sides, ids)
    )
    z, w, near, met = _products(left, right, np.ones(len(ids[0])), np.ones(len(ids[1])), first == last)
    return pd.DataFrame({
        "doc": cell["doc"].iloc[0],
        "id": np.concatenate([ids[0], ids[1][: len(w)]]),
        "z": np.concatenate([z, w]),
        "neighbours": np.concatenate([near, met]),
    })


def block_step(blocks: DataFrame) -> DataFrame:
    """(doc, id, z, neighbours): row sums and positive entries of the clipped similarity.

    Strips of blocks meet in cells, not rows; what leaves a cell is one number per row.
    """
    kind = blocks.schema["doc"].dataType.simpleString()
    sums = cells(blocks).groupBy("doc", "i", "j").applyInPandas(
        _cell, f"doc {kind}, id bigint, z double, neighbours bigint"
    )
    return sums.groupBy("doc", "id").agg(F.sum("z").alias("z"), F.sum("neighbours").alias("neighbours"))


def held_cells(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, places): every cell of two strips as one row (doc, i, j, a, b) of vectors, and where each id stands in its strip.

    Written once, so that a step reads the vectors where they lie and only numbers move.
    """
    listed = F.array_sort(F.collect_list(F.struct("block", "ids", "vs")))
    flat = lambda name: F.flatten(F.transform("_b", lambda b: b[name])).alias(name)
    strips = staged(
        blocks.groupBy("doc", "strip", "strips").agg(listed.alias("_b")).select("doc", "strip", "strips", flat("ids"), flat("vs")), "strips"
    )
    pairs = strips.select("doc", F.col("strip").alias("i"), F.explode(F.sequence("strip", F.col("strips") - 1)).alias("j"))
    side = lambda at, name: strips.select("doc", F.col("strip").alias(at), F.col("vs").alias(name))
    tasks = 4 * blocks.sparkSession.sparkContext.defaultParallelism
    met = pairs.join(side("i", "a"), ["doc", "i"]).join(side("j", "b"), ["doc", "j"]).select("doc", "i", "j", "a", "b")
    places = strips.select("doc", "strip", F.posexplode("ids").alias("pos", "id"))
    return staged(met.repartition(tasks, "doc", "i", "j"), "cells"), staged(places, "places")


def _held_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, id, z) of rows (doc, i, j, a, b, ids_i, x_i, ids_j, x_j)."""
    for batch in batches:
        for r in range(batch.num_rows):
            a, b, left, x, right, y = (batch.column(c)[r].values.to_numpy() for c in range(3, 9))
            own = batch.column(1)[r].as_py() == batch.column(2)[r].as_py()
            z, w, _, _ = _products(a.reshape(len(x), -1), b.reshape(len(y), -1), x, y, own)
            docs = batch.column(0).take(pa.array(np.full(len(z) + len(w), r)))
            ids = np.concatenate([left, right[: len(w)]])
            yield pa.RecordBatch.from_arrays([docs, pa.array(ids), pa.array(np.concatenate([z, w]))], names=["doc", "id", "z"])


def held_step(held: DataFrame, places: DataFrame, x: DataFrame, sent: bool) -> DataFrame:
    """(doc, id, z): clipped similarity times ``x`` (doc, id, x) for the groups in ``x``.

    Only ``x`` and the sums move; with ``sent``, ``x`` goes to all tasks and the vectors stay where they are.
    """
    packed = F.array_sort(F.collect_list(F.struct("pos", "id", "x")))
    lists = places.join(x, ["doc", "id"]).groupBy("doc", "strip").agg(packed.alias("_l"))
    part = lambda name: F.transform("_l", lambda r: r[name]).alias(name)
    lists = lists.select("doc", "strip", part("id"), part("x"))
    lists = F.broadcast(lists) if sent else lists
    side = lambda at: lists.select("doc", F.col("strip").alias(at), F.col("id").alias(f"_id_{at}"), F.col("x").alias(f"_x_{at}"))
    given = held.join(side("i"), ["doc", "i"]).join(side("j"), ["doc", "j"])
    given = given.select("doc", "i", "j", "a", "b", "_id_i", "_x_i", "_id_j", "_x_j")
    kind = held.schema["doc"].dataType.simpleString()
    return given.mapInArrow(_held_cell, f"doc {kind}, id bigint, z double").groupBy("doc", "id").agg(F.sum("z").alias("z"))


def degrees(vectors: DataFrame, key: str, item: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(key, item, neighbours, out_sum) of the cosine graph: positive edges and their sum."""
    found = block_step(unit_blocks(vectors, key, item, vector, block))
    return found.select(
        F.col("doc").alias(key), F.col("id").alias(item), "neighbours", F.col("z").alias("out_sum")
    )


def dense_scores(
    vectors: DataFrame,
    key: str,
    item: str,
    vector: str,
    max_sentences: int = MAX_SENTENCES,
    block: int = BLOCK,
) -> DataFrame:
    """(key, item, score) for dense vectors: groups up to a checked size in one batch row each."""
    rows = vectors.select(key, item, vector)
    large = _large(rows.groupBy(key).agg(F.count(F.lit(1)).alias("cells")), key, max_sentences)
    small = rows if large is None else rows.join(large, key, "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(item).alias("id"), F.col(vector).alias("v"))))
    grouped = small.groupBy(key).agg(ordered.alias("_r"))
    solved = grouped.select(
        key,
        F.arrays_zip(
            F.transform("_r", lambda r: r["id"]).alias("id"),
            _dense_batch(F.transform("_r", lambda r: r["v"])).alias("score"),
        ).alias("_s"),
    ).select(key, F.explode("_s").alias("_s"))
    out = solved.select(key, F.col("_s.id").alias(item), F.col("_s.score").alias("score"))
    if large is not None:
        out = out.unionByName(block_scores(rows.join(large, key, "left_semi"), key, item, vector, block))
    return out.withColumn("score", F.round("score", DIGITS))


def block_scores(vectors: DataFrame, key: str, item: str, vector: str, block: int = BLOCK) -> DataFrame:
    """The same scores for groups of any size, by block products and aggregates; vectors are copied to cells once."""
    held, places = held_cells(unit_blocks(vectors, key, item, vector, block))
    rows = places.count()
    sizes = places.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    ones = places.select("doc", "id").distinct().withColumn("x", F.lit(1.0))
    state = staged(
        held_step(held, places, ones, rows <= SENT_ROWS)
        .join(sizes, "doc")
        .select(
            "doc", "id", "n",
            F.when(F.col("z") == 0, 1.0).otherwise(F.col("z")).alias("out"),
            (F.lit(1.0) / F.col("n")).alias("score"),
            F.lit(False).alias("done"),
        ),
        "ranks",
    )
    for _ in range(MAX_ITERATIONS):
        given = state.where(~F.col("done")).select("doc", "id", (F.col("score") / F.col("out")).alias("x"))
        z = held_step(held, places, given, rows <= SENT_ROWS)
        fresh = DAMPING * F.col("z") + (1.0 - DAMPING) / F.col("n")
        moved = state.join(z, ["doc", "id"], "left").withColumn(
            "_new", F.when(F.col("done"), F.col("score")).otherwise(fresh)
        )
        change = moved.groupBy("doc").agg(
            (F.sum(F.abs(F.col("_new") - F.col("score"))) < TOLERANCE).alias("_still")
        )
        state = staged(
            moved.join(change, "doc").select(
                "doc", "id", "n", "out", F.col("_new").alias("score"),
                (F.col("done") | F.col("_still")).alias("done"),
            ),
            "ranks",
        )
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select(F.col("doc").alias(key), F.col("id").alias(item), "score")


def prefix_budget(df: DataFrame, budget: int, char_per_token: float = 2.0, key: str = "doc_id") -> DataFrame:
    """Sentences that fit as a prefix of the score order: the lower bound of the greedy choice.

    A document's sentences come out of one row of text, so its window is as small as that row.
    """
    line = Window.partitionBy(key).orderBy(F.col("score").desc(), "sent_idx")
    used = F.sum(est_tokens(F.col("sentence"), char_per_token)).over(
        line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn("used", used).where(F.col("used") <= budget)


def choose(ranked: Column, budget: int, char_per_token: float = 2.0) -> Column:
    """Texts chosen from an array of (score, sent_idx, sentence), back in text order.

    Best score first, earlier sentence first on ties. A sentence that does not fit is offered in
    pieces as long as the whole budget; the search goes on after a miss.
    """
    longest = int(budget * char_per_token)
    order = F.array_sort(
        F.transform(
            ranked,
            lambda r: F.struct(
                (-r["score"]).alias("o"), r["sent_idx"].alias("i"), r["sentence"].alias("s")
            ),
        )
    )
    start = F.struct(
        F.lit(0).cast("long").alias("used"),
        F.array().cast("array<struct<i:bigint,k:int,s:string>>").alias("out"),
    )

    def offer(acc: Column, i: Column, k: Column, text: Column) -> Column:
        need = est_tokens(text, char_per_token)
        taken = F.struct(
            (acc["used"] + need).alias("used"),
            F.concat(
                acc["out"],
                F.array(F.struct(i.cast("long").alias("i"), k.cast("int").alias("k"), text.alias("s"))),
            ).alias("out"),
        )
        return F.when(need <= F.lit(budget) - acc["used"], taken).otherwise(acc)

    def take(acc: Column, row: Column) -> Column:
        pieces = F.transform(
            split_long(row["s"], longest), lambda p, k: F.struct(k.alias("k"), p.alias("p"))
        )
        in_pieces = F.reduce(pieces, acc, lambda a, x: offer(a, row["i"], x["k"], x["p"]))
        fits = est_tokens(row["s"], char_per_token) <= F.lit(budget) - acc["used"]
        return (
            F.when(fits, offer(acc, row["i"], F.lit(0), row["s"]))
            .when(F.length(row["s"]) > longest, in_pieces)
            .otherwise(acc)
        )

    picked = F.reduce(order, start, take, lambda acc: acc["out"])
    return F.transform(F.array_sort(picked), lambda r: r["s"])


def select_budget(
    df: DataFrame, budget: int, char_per_token: float = 2.0, key: str = "doc_id"
) -> DataFrame:
    """(doc_id, pieces) from sentence rows (doc_id, sent_idx, sentence, score)."""
    rows = F.collect_list(F.struct("score", "sent_idx", "sentence"))
    return df.groupBy(key).agg(rows.alias("_r")).select(
        key, choose(F.col("_r"), budget, char_per_token).alias("pieces")
    )
