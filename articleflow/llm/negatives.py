"""Hard negatives by exact integer scores, after the method of the Four Russians.

Candidates keep their components as bit planes: a byte holds one bit of eight dimensions. An anchor's table has, for
each group of eight dimensions, the sums of all 256 subsets of its components; a plane's sum is a lookup for each
group, and planes are joined from the highest to the lowest by a shift and an addition. Scores are exact and full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.llm import blocks
from articleflow.llm.common import staged

#: Components are floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score in hundredths of the positive's: at least, and at most.
BAND = (80, 100)
#: Anchors and candidates scored at once; bounds the memory of a step.
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 16, 4096
TILE = "dims long, bits long, ids binary, labels binary, planes binary"
BLOCK = "dims long, ids binary, labels binary, whole binary"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) in 64 bits; components of 2^31 and more in size are refused, as their products do not fit."""
    scaled = np.floor(float(SCALE) * vectors)
    if scaled.size and np.abs(scaled).max() >= 1 << 31:
        raise ValueError("a component is too large for exact scores of 64 bits")
    return scaled.astype(np.int64)


def bit_planes(values: np.ndarray) -> tuple[np.ndarray, int]:
    """(bits, groups, rows) bytes of the two's complement of (rows, dims) integers, and the number of bits."""
    bits = max(int(values.max(initial=0)).bit_length(), int(-values.min(initial=0) - 1).bit_length() if values.min(initial=0) < 0 else 0) + 1
    planes = [np.packbits((values >> k & 1).astype(np.uint8), axis=1, bitorder="little").T for k in range(bits)]
    return np.ascontiguousarray(np.stack(planes)), bits


def subset_sums(anchors: np.ndarray, groups: int, kind: type) -> np.ndarray:
    """(groups, 256, anchors): sums of the components that a byte names."""
    padded = np.zeros((len(anchors), groups * 8), kind)
    padded[:, : anchors.shape[1]] = anchors
    parts = padded.reshape(len(anchors), groups, 8)
    sums = np.zeros((groups, 256, len(anchors)), kind)
    for d in range(8):
        sums[:, 1 << d : 2 << d] = sums[:, : 1 << d] + parts[:, None, :, d].transpose(2, 1, 0)
    return sums


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): inner products by table lookups."""
    bits, groups, rows = planes.shape
    anchors = anchors[:, : groups * 8]
    most = int(np.abs(anchors).sum(1).max(initial=0)) << bits
    if most >= 1 << 63:
        raise ValueError("inner products do not fit 64 bits")
    kind = np.int32 if most < 1 << 31 else np.int64
    made = np.empty((rows, len(anchors)), np.int64)
    for a in range(0, len(anchors), ANCHORS_AT_ONCE):
        sums = subset_sums(anchors[a : a + ANCHORS_AT_ONCE], groups, kind)
        for r in range(0, rows, ROWS_AT_ONCE):
            piece = planes[:, :, r : r + ROWS_AT_ONCE]
            total = np.zeros((piece.shape[2], sums.shape[2]), kind)
            for k in range(bits - 1, -1, -1):
                total <<= 1
                for g in range(groups):
                    part = sums[g][piece[k, g]]
                    if k == bits - 1:
                        total -= part  # the highest plane is the sign
                    else:
                        total += part
            made[r : r + ROWS_AT_ONCE, a : a + ANCHORS_AT_ONCE] = total
    return made


def _unpack(tile: dict, block: dict):
    n, dims = tile["n"], tile["dims"]
    planes = np.frombuffer(tile["planes"], np.uint8).reshape(tile["bits"], -(-dims // 8), n)
    ids, labels = (np.frombuffer(tile[c], np.int64) for c in ("ids", "labels"))
    anchors = np.frombuffer(block["whole"], np.int64).reshape(block["n"], block["dims"])
    return ids, np.where(ids == blocks.NO_ID, np.iinfo(np.int64).max, ids), labels, planes, anchors


def _first(scored: np.ndarray, rank_ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` highest scores, ties by id."""
    at = np.arange(len(scored))
    if len(at) > most:
        at = np.flatnonzero(scored >= np.partition(scored, len(at) - most)[len(at) - most])
    return at[np.lexsort((rank_ids[at], -scored[at]))][:most]


def _joined(parts: dict[str, list]) -> dict[str, np.ndarray]:
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def same_label(tile: dict, block: dict, most: int) -> dict[str, np.ndarray]:
    """The ``most`` best rows of each anchor's label in a tile, its own row included."""
    ids, rank_ids, labels, planes, anchors = _unpack(tile, block)
    anchor_ids, anchor_labels = (np.frombuffer(block[c], np.int64) for c in ("ids", "labels"))
    found = {"row": [], "anchor_id": [], "vec_id": [], "score": [], "own_score": []}
    for label in np.unique(anchor_labels):
        here = np.flatnonzero(labels == label)
        mine = np.flatnonzero(anchor_labels == label)
        if not len(here):
            continue
        scored = scores(anchors[mine], np.ascontiguousarray(planes[:, :, here]))
        for column, i in enumerate(mine.tolist()):
            at = _first(scored[:, column], rank_ids[here], most)
            found["row"].append(np.full(len(at), (block["part"] << 16) + i))
            found["anchor_id"].append(np.full(len(at), anchor_ids[i]))
            found["vec_id"].append(ids[here[at]])
            found["score"].append(scored[at, column])
            found["own_score"].append(np.full(len(at), int((anchors[i] * anchors[i]).sum())))
    return _joined(found)


def other_labels(tile: dict, block: dict, most: int) -> dict[str, np.ndarray]:
    """For each anchor and positive the ``most`` best rows of other labels inside the band."""
    ids, rank_ids, labels, planes, anchors = _unpack(tile, block)
    anchor_labels = np.frombuffer(block["labels"], np.int64)
    at_row, places, limits = (np.array(block[c], np.int64) for c in ("p_row", "p_rank", "p_score"))
    of = (at_row & 0xFFFF).astype(np.int64)
    open_ones = limits >= 0  # below zero the band is empty
    found = {"row": [], "p_rank": [], "vec_id": [], "score": []}
    wanted = np.unique(of[open_ones])
    for first in range(0, len(wanted), ANCHORS_AT_ONCE):
        group = wanted[first : first + ANCHORS_AT_ONCE]
        scored = scores(anchors[group], planes)
        for column, i in enumerate(group.tolist()):
            mine = np.flatnonzero((of == i) & open_ones)
            values = scored[:, column]
            low = -(-BAND[0] * int(limits[mine].min()) // 100)
            here = np.flatnonzero((labels != anchor_labels[i]) & (values >= low))
            here = here[np.lexsort((rank_ids[here], -values[here]))]
            ordered = values[here]
            for p in mine.tolist():
                limit = int(limits[p])
                start = int(np.searchsorted(-ordered, -(BAND[1] * limit // 100), "left"))
                inside = here[start : start + most]
                inside = inside[100 * values[inside] >= BAND[0] * limit]
                found["row"].append(np.full(len(inside), (block["part"] << 16) + i))
                found["p_rank"].append(np.full(len(inside), places[p]))
                found["vec_id"].append(ids[inside])
                found["score"].append(values[inside])
    return _joined(found)


def mine(
    vectors: DataFrame, anchors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row of ``anchors``, rows of ``vectors``.

    An anchor's positives are its best ``positives`` other rows of its label; for each of them come the best ``negatives``
    rows of other labels whose score lies in ``BAND`` of the positive's. Rows with a null label, a null or empty
    vector, or null or non-finite components take no part; shorter vectors count as padded with zeros. Ties go to
    the smaller id, null ids last. Repeated rows are rows of their own, so an anchor's copies are its positives.
    An anchor without positives, a positive of negative score and an empty table give no rows. Other columns are
    not read. One label may hold any share of the rows: tiles know no labels.
    """
    spark = vectors.sparkSession
    usable = lambda df: df.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    ).where(F.col("label").isNotNull() & blocks.finite(F.col("vector")))
    rows = usable(vectors)

    def tile(c: dict[str, np.ndarray]) -> dict:
        planes, bits = bit_planes(whole(c["vector"]))
        return {"dims": c["vector"].shape[1], "bits": bits, "ids": c["vec_id"].tobytes(), "labels": c["label"].tobytes(), "planes": planes.tobytes()}

    def block(c: dict[str, np.ndarray]) -> dict:
        return {"dims": c["vector"].shape[1], "ids": c["vec_id"].tobytes(), "labels": c["label"].tobytes(), "whole": whole(c["vector"]).tobytes()}

    wanted, numbers = blocks.query_blocks(usable(anchors), block, BLOCK)
    if not numbers:
        return spark.createDataFrame([], OUT)
    tiles = staged(blocks.packed(blocks.few_parts(rows, rows.count(), blocks.TILE_ROWS), tile, TILE, blocks.TILE_ROWS), "bit-planes")
    found = blocks.against_all(
        tiles, wanted, numbers, lambda t, b: same_label(t, b, positives + 1),
        "row long, anchor_id long, vec_id long, score long, own_score long", "positives-found",
    )
    best = staged(_without_own(found, positives), "positives")
    # at most ``positives`` rows for each anchor of a block
    lists = best.select((F.shiftright("row", 16)).alias("part"), F.struct("row", "p_rank", "score").alias("p")).groupBy("part").agg(
        F.sort_array(F.collect_list("p")).alias("p")
    )
    armed = wanted.join(lists, "part").select(
        *wanted.columns, F.col("p.row").alias("p_row"), F.col("p.p_rank").alias("p_rank"), F.col("p.score").alias("p_score")
    )
    armed = staged(armed, "anchor-blocks")
    found = blocks.against_all(
        tiles, armed, numbers, lambda t, b: other_labels(t, b, negatives), "row long, p_rank long, vec_id long, score long", "negatives-found"
    )
    order = Window.partitionBy("row", "p_rank").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    hard = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = best.select("row", "p_rank", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, ["row", "p_rank"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _without_own(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every anchor but for its own row, which has its id and its score with itself."""
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last()]
    by_row = Window.partitionBy("row")
    own = F.col("vec_id").eqNullSafe(F.col("anchor_id")) & (F.col("score") == F.col("own_score"))
    near = found.withColumn("_at", F.row_number().over(by_row.orderBy(*order))).where(F.col("_at") <= k + 1)
    near = near.withColumn("_own", F.min(F.when(own, F.col("_at"))).over(by_row))
    kept = near.where(F.col("_own").isNull() | (F.col("_at") != F.col("_own")))
    ranked = kept.withColumn("p_rank", F.row_number().over(by_row.orderBy(*order)).cast("long"))
    return ranked.where(F.col("p_rank") <= k).select("row", "anchor_id", "vec_id", "score", "p_rank")
