"""Simple-8b files of token ids: 64-bit words whose top four bits say how many ids of how many bits follow.

A file is a Parquet table of blocks, so any store that Spark reads holds it and task commits make it whole.
A block has the ids of whole documents: their counts, the ids of the part before it, the words, and the
exceptions (ids of 60 bits and more, to which escape words point).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.llm.encode import encoded_rows, encoder

#: (ids, bits each) by selector, from 1 up; selector 0 is an escape that holds an index of the exceptions.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK_IDS = 1 << 16
BLOCKS = "part long, block long, first long, doc_ids array<long>, counts array<long>, words binary, exceptions binary"


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and exceptions: each word takes as many ids as fit, from the left."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    selector = np.zeros(n, np.uint8)
    for s in range(len(LAYOUTS), 0, -1):  # later ones take more ids
        count, bits = LAYOUTS[s - 1]
        if n >= count:
            over = np.zeros(n + 1, np.int64)
            np.cumsum(ids >> np.uint64(bits) != 0, out=over[1:])
            selector[: n - count + 1][over[count:] == over[: n - count + 1]] = s
    takes = np.array([1, *(c for c, _ in LAYOUTS)])[selector].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += takes[at]
    starts = np.array(starts)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if not s:
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            continue
        count, bits = LAYOUTS[s - 1]
        for k in range(count):
            words[mine] |= ids[starts[mine] + k] << np.uint64(k * bits)
    return words, ids[starts[chosen == 0]]


def decode_words(words: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    """The ids of a block; all words of a selector at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *(c for c, _ in LAYOUTS)])[selector]
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        at = (ends - counts)[mine]
        if not s:
            ids[at] = exceptions[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        count, bits = LAYOUTS[s - 1]
        for k in range(count):
            ids[at + k] = words[mine] >> np.uint64(k * bits) & np.uint64((1 << bits) - 1)
    return ids


def _schema() -> pa.Schema:
    longs = pa.list_(pa.int64())
    kinds = (pa.int64(), pa.int64(), pa.int64(), longs, longs, pa.binary(), pa.binary())
    return pa.schema([(part.split()[0], kind) for part, kind in zip(BLOCKS.split(", "), kinds, strict=True)])


def write(documents: DataFrame, path: str, tokenizer_path: str, blanks: bool, end_id: int) -> None:
    """Encode whole texts and write their ids in ascending doc_id order; equal ids in the order of a text hash.

    Null doc_ids come first, null texts are empty and have only ``end_id``. Texts are ranged by id before they
    are encoded, so ids never travel; equal rows may lie in several parts. Other columns are not read.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, schema = encoder(tokenizer_path, blanks).encode_all, _schema()
        part, block, first = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            words, exceptions = encode_words(np.frombuffer(b"".join(held), "<u4"))
            row = ([part], [block], [first], [docs], [[len(h) // 4 for h in held]], [words.astype("<u8").tobytes()], [exceptions.astype("<u8").tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for given in batches:
            for doc, encoded in encoded_rows(given, encode_all):
                docs.append(doc)
                held.append(encoded + tail)
                size += len(held[-1]) // 4
                if size >= BLOCK_IDS:
                    yield made()
                    first, block, size, docs, held = first + size, block + 1, 0, [], []
        if docs:
            yield made()

    ordered = (
        documents.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row"))
        .repartitionByRange("doc_id", "_tie", "_row").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    )
    ordered.mapInArrow(run, BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file: doc_id, start (ids of all documents before it), n_tokens, ids."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    ddl = "doc_id long, part long, inside long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for row in given.to_pylist():
                ids = decode_words(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["exceptions"], "<u8"))
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                data = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(counts), pa.int64()),
                        pa.array(row["first"] + ends - counts), pa.array(counts),
                        pa.array([data[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "part", "inside", "n_tokens", "ids"],
                )

    # one row of two numbers per part, and no more parts than tasks of the writing job: sent to all tasks, so ids stay where they are
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_ids"))
        .select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("before"))
    )
    docs = blocks.select("part", "block", "first", "doc_ids", "counts", "words", "exceptions").mapInArrow(run, ddl)
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids")
