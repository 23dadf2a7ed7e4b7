"""Several tables that change together: immutable versions, and one small pointer that is published last.

A version is a folder that nobody reads until its pointer exists. A pointer is one row, written by one task and
committed by Spark after all tables are complete, so a writer that breaks off anywhere leaves the older version as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from articleflow.sources.tables import write_snapshot

POINTER = "version long, folder string, tables array<string>"


class VersionedTables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema(POINTER).option("recursiveFileLookup", "true").parquet(f"{self.path}/pointers")

    def latest(self) -> tuple[int, str, list[str]] | None:
        """(version, folder, tables) of the newest complete version; None before the first one."""
        try:
            row = self._pointers().orderBy("version", ascending=False).first()
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return None if row is None else (row["version"], row["folder"], row["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the newest version, or of a given one."""
        if version is None:
            found = self.latest()
        else:
            row = self._pointers().where(f"version = {int(version)}").first()
            found = row and (row["version"], row["folder"], row["tables"])
        if found is None or name not in found[2]:
            raise ValueError(f"no complete version holds {name}")
        return self.spark.read.parquet(f"{self.path}/{found[1]}/{name}.parquet")

    def publish(self, tables: Mapping[str, DataFrame], after: int | None = None) -> int:
        """All tables as one new version; returns its number.

        ``after`` is the version that the tables were made from: if another one has been published since, nothing is,
        and the caller starts again from the newer one. Tables may read from the version they replace.
        """
        found = self.latest()
        now = found[0] if found else 0
        if after is not None and after != now:
            raise RuntimeError(f"version {now} was published after {after}")
        folder = f"versions/{now + 1:09d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            write_snapshot(df, f"{self.path}/{folder}/{name}.parquet")
        pointer = self.spark.createDataFrame([(now + 1, folder, list(tables))], POINTER).coalesce(1)
        # a second writer of this number finds its path taken
        write_snapshot(pointer, f"{self.path}/pointers/{now + 1:09d}")
        return now + 1
