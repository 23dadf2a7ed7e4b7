"""Packing of token sequences by balanced attention cost.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``. Pieces in descending cost go to the cheapest
sequence that still has room for them, or, when none of the pool has, are cut to fill the cheapest.
A task packs the documents it reads, pool by pool, so nothing is shuffled and memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from articleflow.llm.common import arrow_schema
from articleflow.llm.encode import encoded_rows, encoder

LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that wait to be packed together; the last pool of a task is smaller.
POOL_TOKENS = 1 << 20
PARTS_BIT = 33
DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


@dataclass(frozen=True)
class Piece:
    """``ids`` are little-endian unsigned 32-bit integers; ``start`` counts the document's ids before it."""

    doc: int | None
    start: int
    tokens: int
    ids: bytes

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.tokens, self.ids[: 4 * n]), Piece(self.doc, self.start + n, self.tokens, self.ids[4 * n :])


def rooms(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences for so many tokens: full ones, and powers of two for what is left, so none is padded."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pack(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Sequences of pieces; their lengths are those of ``rooms``."""
    room = np.array(rooms(sum(map(len, pieces)), capacity), np.int64)
    spent = np.zeros(len(room))
    sequences: list[list[Piece]] = [[] for _ in room]
    for piece in sorted(pieces, key=lambda p: (-cost(len(p)), p.doc is None, p.doc or 0, p.start, p.ids)):
        while len(piece):
            fits = room >= len(piece)
            at = int(np.where(fits if fits.any() else room > 0, spent, np.inf).argmin())
            part, piece = piece.cut(min(len(piece), int(room[at])))
            sequences[at].append(part)
            room[at] -= len(part)
            spent[at] += cost(len(part))
    return sequences


def pack_documents(
    documents: DataFrame, tokenizer_path: str, blanks: bool = True, end_id: int = 0, capacity: int = 1024
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, cost, ids.

    Each document's ids end with ``end_id``, so null and empty texts have one id. Full sequences are cut off
    a document first; what is left of it is packed. Every id lies in exactly one piece, offsets of a sequence
    have no gaps, and no sequence needs padding: its length is ``capacity`` or a power of two. Repeated rows
    are packed like others; columns other than doc_id and text are not read. A task that runs again reads the
    same rows in the same order and gives the same sequences.
    """
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, encode_all = arrow_schema(DDL), encoder(tokenizer_path, blanks).encode_all
        first = TaskContext.get().partitionId() << PARTS_BIT
        used, pool, waiting = 0, [], 0
        rows: list[tuple] = []

        def place(sequence: list[Piece]) -> None:
            nonlocal used
            offset = 0
            for p in sequence:
                rows.append((p.doc, p.start, len(p), p.tokens, first + used, offset, cost(len(p)), p.ids))
                offset += len(p)
            used += 1

        def batch() -> pa.RecordBatch:
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, schema=schema)

        for given in batches:
            for doc, encoded in encoded_rows(given, encode_all):
                ids = encoded + tail
                left = Piece(doc, 0, len(ids) // 4, ids)
                while len(left) >= capacity:
                    part, left = left.cut(capacity)
                    place([part])
                    if len(rows) >= 4096:
                        yield batch()
                if len(left):
                    pool.append(left)
                    waiting += len(left)
                if waiting >= POOL_TOKENS:
                    for sequence in pack(pool, capacity):
                        place(sequence)
                    pool, waiting = [], 0
                    yield batch()
        for sequence in pack(pool, capacity):
            place(sequence)
        if rows:
            yield batch()

    return documents.select("doc_id", "text").mapInArrow(run, DDL)
