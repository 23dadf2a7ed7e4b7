"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from articleflow.session import staged  # noqa: F401

Rows = Callable[[list, list], dict[str, list]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow types of the few Spark types that these operators return."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def map_texts(df: DataFrame, key: str, text: str, ddl: str, rows: Rows) -> DataFrame:
    """``rows(keys, texts)`` over whole texts, batch by batch inside tasks; no shuffle, no state between rows.

    Only ``key`` and ``text`` are read. A null text reaches ``rows`` as an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = rows(keys, texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) for f in schema], schema=schema
            )

    return df.select(key, text).mapInArrow(run, ddl)
