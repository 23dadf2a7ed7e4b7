"""A query set against all rows, in blocks: rows as tiles (narrow, no shuffle), queries as blocks of bounded size.

Tiles and blocks are single rows that hold packed columns. One block at a time is sent to all tasks; its size is
bounded by ``BLOCK_ROWS``, so neither memory nor a broadcast grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import staged

#: Rows of a tile and of a block of queries, at most; at 64 single floats 4 MB each.
TILE_ROWS = 1 << 14
BLOCK_ROWS = 1 << 14
PART_BITS = 32
#: Stands for a missing id inside packed columns.
NO_ID = -(1 << 63)


def finite(vector: Column) -> Column:
    """No null vector, no empty one, and no component that is null or not a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def packed(rows: DataFrame, make: Callable[[dict[str, np.ndarray]], dict[str, bytes]], ddl: str, most: int) -> DataFrame:
    """Rows gathered inside tasks into single rows of up to ``most``: part, n, and the columns that ``make`` packs.

    ``rows`` has long, int and array<double> columns; arrays of one task may differ in length and come to
    ``make`` padded with zeros. Long columns have ``NO_ID`` for null.
    """
    names = rows.columns
    out = [name.split()[0] for name in ddl.split(", ")]

    def row(held: list[pa.RecordBatch], at: int) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        columns = {}
        for name in names:
            column = whole[name].combine_chunks()
            if pa.types.is_list(column.type):
                sizes = np.diff(column.offsets.to_numpy())
                flat = column.flatten().to_numpy(zero_copy_only=False)
                if len(sizes) and (sizes == sizes[0]).all():
                    columns[name] = flat.reshape(len(sizes), -1)
                else:
                    wide = np.zeros((len(sizes), int(sizes.max(initial=0))))
                    wide[np.arange(wide.shape[1]) < sizes[:, None]] = flat
                    columns[name] = wide
            else:
                columns[name] = column.fill_null(NO_ID).to_numpy()
        made = make(columns)
        values = [[at], [whole.num_rows], *([made[name]] for name in out)]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["part", "n", *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, used = [], 0, 0
        first = TaskContext.get().partitionId() << PART_BITS
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, most - size)
                batch = batch.slice(piece.num_rows)
                held.append(piece)
                size += piece.num_rows
                if size == most:
                    yield row(held, first + used)
                    held, size, used = [], 0, used + 1
        if size:
            yield row(held, first + used)

    return rows.mapInArrow(run, f"part long, n long, {ddl}")


def few_parts(rows: DataFrame, count: int, most: int) -> DataFrame:
    """Scan parts merged (no shuffle) until a part fills a tile, but never fewer than the cores."""
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // most))
    return rows.coalesce(wanted) if rows.rdd.getNumPartitions() > wanted else rows


def query_blocks(rows: DataFrame, make: Callable, ddl: str) -> tuple[DataFrame, list[int]]:
    """Staged blocks of queries and their numbers: one for each ``BLOCK_ROWS`` queries, so few."""
    count = rows.count()
    spread = rows.repartition(-(-count // BLOCK_ROWS)) if count else rows
    blocks = staged(packed(spread, make, ddl, BLOCK_ROWS), "query-blocks")
    return blocks, [r.part for r in blocks.select("part").orderBy("part").toLocalIterator()]


def against_all(
    tiles: DataFrame, blocks: DataFrame, numbers: list[int], search: Callable[[dict, dict], dict[str, np.ndarray]], ddl: str, label: str
) -> DataFrame:
    """``search(tile, block)`` of every tile and every block, one block at a time; results are staged block by block."""
    spark = tiles.sparkSession
    names, columns = tiles.columns, blocks.columns
    renamed = blocks.select(*(F.col(c).alias(f"_q_{c}") for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                found = search({c: value[c] for c in names}, {c: value[f"_q_{c}"] for c in columns})
                arrays = {k: pa.array(v) if v.dtype != np.int64 else pa.array(v, mask=v == NO_ID) for k, v in found.items()}
                yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    made = []
    for number in numbers:
        block = F.broadcast(renamed.where(F.col("_q_part") == number))
        # generated, so that the key is not folded away and the join stays one by key
        keyed = tiles.select("*", F.explode(F.array(F.lit(number).cast("long"))).alias("_block"))
        pairs = keyed.join(block, F.col("_block") == F.col("_q_part"))
        made.append(staged(pairs.drop("_block").mapInArrow(run, ddl), label))
    return reduce(DataFrame.unionAll, made) if made else spark.createDataFrame([], ddl)
