"""Nearest neighbours by multi-index hashing: rotated binary codes of 64 bits, cut into substrings that are each indexed.

A code within r bits of another one agrees with it up to ``r // parts`` bits in one of its substrings at least, so
probing every substring's table within that many bits retrieves every code within r; the vectors of these are
compared exactly. The rotation is learned on a bounded sample, the radius from the true neighbours of a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.llm import blocks
from articleflow.llm.common import staged

BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
#: Bounded samples, in rows: for the rotation, and for the radius (each of the latter is compared with all rows).
SAMPLE_ROWS, RADIUS_ROWS = 8192, 64
#: Share of the true neighbours of the radius sample that the radius must cover.
COVERED = 0.97
ROUNDS = 25
TILE = "dims long, ids binary, vectors binary, codes binary, orders binary"
FOUND = "row long, query_id long, vec_id long, distance double"


@dataclass(frozen=True)
class Rotation:
    """A code's bit is set where the rotated, centred vector is positive."""

    centre: np.ndarray
    matrix: np.ndarray

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        width = min(vectors.shape[1], len(self.centre))
        length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
        rotated = (vectors[:, :width] / np.where(length > 0, length, 1.0) - self.centre[:width]) @ self.matrix[:width]
        return np.packbits(rotated > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def learn_rotation(sample: np.ndarray, seed: int = 7) -> Rotation:
    """Iterative quantisation: principal directions, then rotations that bring the sample nearest to the corners of a cube.

    Vectors of fewer dimensions than bits get several rotations side by side.
    """
    length = np.sqrt((sample * sample).sum(1, keepdims=True))
    unit = sample / np.where(length > 0, length, 1.0)
    centre = unit.mean(0)
    _, directions = np.linalg.eigh((unit - centre).T @ (unit - centre))
    directions = directions[:, ::-1][:, :BITS]
    low = (unit - centre) @ directions
    numbers = np.random.default_rng(seed)
    columns: list[np.ndarray] = []
    while sum(c.shape[1] for c in columns) < BITS:
        turn = np.linalg.qr(numbers.normal(size=(low.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        columns.append(directions @ turn)
    return Rotation(centre, np.hstack(columns)[:, :BITS])


@lru_cache(maxsize=32)
def ball(radius: int) -> np.ndarray:
    """All substring differences of up to ``radius`` bits."""
    every = np.arange(1 << WIDTH, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius]


def substrings(codes: np.ndarray) -> np.ndarray:
    """(rows, PARTS)."""
    return np.ascontiguousarray(codes)[:, None].view(np.uint16)


def packed_vectors(vectors: np.ndarray) -> bytes:
    """Single floats where they hold every component exactly, else double ones."""
    single = vectors.astype("<f4")
    return single.tobytes() if (single == vectors).all() else vectors.astype("<f8").tobytes()


def unpacked(data: bytes | memoryview, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * n * dims else "<f8").reshape(n, dims).astype(np.float64)


def index(vectors: np.ndarray, ids: np.ndarray, rotation: Rotation) -> dict[str, bytes]:
    """A tile: ids, vectors, codes, and for each substring the rows in its order."""
    codes = rotation.codes(vectors)
    orders = np.argsort(substrings(codes), axis=0, kind="stable").astype(np.uint32)
    return {
        "dims": vectors.shape[1], "ids": ids.tobytes(), "vectors": packed_vectors(vectors), "codes": codes.tobytes(),
        "orders": np.ascontiguousarray(orders.T).tobytes(),
    }


def starts_of(codes: np.ndarray) -> list[np.ndarray]:
    """For each substring where the rows of every value start in its order."""
    return [np.append(0, np.cumsum(np.bincount(part, minlength=1 << WIDTH))) for part in substrings(codes).T]


def within(code: np.uint64, codes: np.ndarray, orders: np.ndarray, starts: list[np.ndarray], radius: int) -> np.ndarray:
    """Rows of a tile whose code is within ``radius`` bits, found by their substrings."""
    # r = PARTS * a + b: the first b + 1 substrings are probed within a bits, the others within a - 1
    a, b = divmod(radius, PARTS)
    seen = np.zeros(len(codes), bool)
    for j, part in enumerate(substrings(np.array([code]))[0]):
        near = a if j <= b else a - 1
        if near < 0:
            continue
        values = ball(near) ^ np.uint32(part)
        low = starts[j][values]
        runs = starts[j][values + 1] - low
        full = runs > 0
        low, runs = low[full], runs[full]
        seen[orders[j][np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())]] = True
    rows = np.flatnonzero(seen)
    return rows[np.bitwise_count(codes[rows] ^ code) <= radius]


def nearest_in_tile(tile: dict, block: dict, rotation: Rotation, radius: int, most: int) -> dict[str, np.ndarray]:
    """The ``most`` nearest rows of a tile among those within the radius, for every query of a block; own rows included."""
    n, dims = tile["n"], max(tile["dims"], block["dims"])
    vectors, asked = (np.pad(unpacked(x["vectors"], x["n"], x["dims"]), ((0, 0), (0, dims - x["dims"]))) for x in (tile, block))
    ids, codes = np.frombuffer(tile["ids"], np.int64), np.frombuffer(tile["codes"], np.uint64)
    orders, starts = np.frombuffer(tile["orders"], np.uint32).reshape(PARTS, n), starts_of(codes)
    rank_ids = np.where(ids == blocks.NO_ID, np.iinfo(np.int64).max, ids)
    rows, heres, distances = [], [], []
    for i, code in enumerate(rotation.codes(asked)):
        here = within(code, codes, orders, starts, radius)
        gap = vectors[here] - asked[i]
        distance = np.sqrt((gap * gap).sum(1))
        if len(here) > most:
            bound = np.partition(distance, most - 1)[most - 1]
            kept = distance <= bound
            here, distance = here[kept], distance[kept]
        order = np.lexsort((rank_ids[here], distance))[:most]
        rows.append(np.full(len(order), (block["part"] << 16) + i))
        heres.append(here[order])
        distances.append(distance[order])
    rows, heres = np.concatenate(rows), np.concatenate(heres)
    query_ids = np.frombuffer(block["ids"], np.int64)
    return {"row": rows, "query_id": query_ids[rows & 0xFFFF], "vec_id": ids[heres], "distance": np.concatenate(distances)}


def learn_radius(rows: DataFrame, sample: np.ndarray, rotation: Rotation, k: int) -> int:
    """The radius that holds ``COVERED`` of the true ``k`` neighbours of ``sample``, each compared with all rows once.

    Tasks return k distances for each row of the sample, so the driver gets RADIUS_ROWS * k numbers a task.
    """
    count, codes = len(sample), rotation.codes(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, bits = np.full((count, k + 1), np.inf), np.full((count, k + 1), BITS)
        for batch in batches:
            for row in batch.to_pylist():
                vectors = unpacked(row["vectors"], row["n"], row["dims"])
                dims = min(vectors.shape[1], sample.shape[1])
                square = (vectors * vectors).sum(1)[None, :] - 2 * (sample[:, :dims] @ vectors[:, :dims].T)
                apart = np.bitwise_count(codes[:, None] ^ np.frombuffer(row["codes"], np.uint64)[None, :])
                square, apart = np.hstack([best, square]), np.hstack([bits, apart])
                at = np.argpartition(square, k, axis=1)[:, : k + 1]
                best, bits = np.take_along_axis(square, at, 1), np.take_along_axis(apart, at, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(count), k + 1)), pa.array(best.ravel()), pa.array(bits.ravel().astype(np.int64))], names=["q", "d", "bits"]
        )

    found = rows.select("n", "dims", "vectors", "codes").mapInArrow(run, "q long, d double, bits long").where("d < double('inf')")
    order = Window.partitionBy("q").orderBy("d", "bits")
    near = found.withColumn("r", F.row_number().over(order)).where(F.col("r").between(2, k + 1))
    counts = {r["bits"]: r["count"] for r in near.groupBy("bits").count().toLocalIterator()}
    total, so_far = sum(counts.values()), 0
    for bits in sorted(counts):
        so_far += counts[bits]
        if so_far >= COVERED * total:
            return bits
    return BITS


def sample_vectors(rows: DataFrame, most: int, salt: int) -> np.ndarray:
    """``most`` vectors by the order of a hash, padded with zeros to one length."""
    taken = rows.orderBy(F.xxhash64(F.lit(salt), "vector")).limit(most).toArrow()["vector"].to_pylist()
    wide = np.zeros((len(taken), max(map(len, taken), default=0)))
    for i, v in enumerate(taken):
        wide[i, : len(v)] = v
    return wide


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", radius: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` (rows of ``vectors``) its k nearest other rows that the index finds.

    Rows whose vector is null, empty, zero, or holds null or non-finite components take no part; shorter vectors
    count as padded with zeros. Nearest first by Euclidean distance in double precision, ties by smaller id, null
    ids last. Repeated query rows are searched one by one, and each finds the other copies. Other columns are not
    read. An empty table gives no rows. ``radius`` fixes the bits; otherwise they are learned.
    """
    usable = lambda df: df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(
        blocks.finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    )
    rows, asked = usable(vectors), usable(queries)
    spark = vectors.sparkSession
    sample = sample_vectors(rows, SAMPLE_ROWS, 1)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rotation = learn_rotation(sample)
    pack = lambda c: index(c["vector"], c["vec_id"], rotation)
    tiles = staged(blocks.packed(blocks.few_parts(rows, rows.count(), blocks.TILE_ROWS), pack, TILE, blocks.TILE_ROWS), "multi-index")
    reach = radius if radius is not None else learn_radius(tiles, sample_vectors(rows, RADIUS_ROWS, 2), rotation, k)
    plain = lambda c: {"dims": c["vector"].shape[1], "ids": c["vec_id"].tobytes(), "vectors": packed_vectors(c["vector"])}
    wanted, numbers = blocks.query_blocks(asked, plain, "dims long, ids binary, vectors binary")
    found = blocks.against_all(
        tiles, wanted, numbers, lambda t, b: nearest_in_tile(t, b, rotation, reach, k + 1), FOUND, "multi-index-found"
    )
    return first_others(found, "distance", k)


def first_others(found: DataFrame, measure: str, k: int) -> DataFrame:
    """The k first rows of every query without its own row, which is one of those with its id at distance zero."""
    order = [F.col(measure), F.col("vec_id").asc_nulls_last()]
    own = F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col(measure) == 0)
    near = found.withColumn("_at", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("_at") <= k + 1)
    near = near.withColumn("_own", F.min(F.when(own, F.col("_at"))).over(Window.partitionBy("row")))
    kept = near.where(F.col("_own").isNull() | (F.col("_at") != F.col("_own")))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col(measure).alias("score"))
