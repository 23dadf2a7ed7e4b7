"""A lasting index of the contents that earlier micro-batches have written.

Hashes lie in buckets by their first digits. Each batch adds a run; as soon as there are ``FAN`` runs of one size they are
merged into one of the next size. A batch therefore reads at most ``FAN - 1`` runs of each size, and of these only the
buckets that its own hashes fall into. Which runs stand for the batches before a given one follows from its number
alone, so a replayed batch reads what it read the first time and overwrites what it wrote.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 4
BUCKETS = 64
ROWS = "content_hash string, seq long, bucket int"


def runs_before(batch: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(first, end) of the runs that hold all batches before this one, largest first."""
    size = 1
    while size * fan <= batch:
        size *= fan
    runs, at = [], 0
    while at < batch:
        while at + size > batch:
            size //= fan
        runs.append((at, at + size))
        at += size
    return runs


class ContentIndex:
    def __init__(self, spark: SparkSession, path: str, fan: int = FAN, buckets: int = BUCKETS):
        self.spark, self.path, self.fan, self.buckets = spark, path, fan, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        digits = F.conv(F.substring("content_hash", 1, 4), 16, 10).cast("int")
        seq = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(None).cast("long")
        return rows.select("content_hash", seq.alias("seq"), (digits % self.buckets).alias("bucket"))

    def _run(self, first: int, end: int) -> str:
        return f"{self.path}/run-{first:09d}-{end:09d}"

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        read = [self.spark.read.schema(ROWS).parquet(self._run(*r)) for r in runs]
        return reduce(DataFrame.unionAll, read) if read else self.spark.createDataFrame([], ROWS)

    def _write(self, rows: DataFrame, first: int, end: int) -> None:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._run(first, end))

    def known(self, rows: DataFrame, batch: int) -> DataFrame:
        """(content_hash, seq) of earlier batches in the buckets of ``rows``; at most ``buckets`` numbers reach the driver."""
        wanted = [r["bucket"] for r in self._bucketed(rows).select("bucket").distinct().collect()]
        return self._read(runs_before(batch, self.fan)).where(F.col("bucket").isin(wanted)).select("content_hash", "seq")

    def unknown(self, rows: DataFrame, batch: int) -> DataFrame:
        """``rows`` whose content no earlier batch has written; with a ``seq``, not with the same or a smaller one."""
        if not batch:
            return rows
        known = self.known(rows, batch).toDF("_hash", "_seq")
        met = F.col("content_hash") == F.col("_hash")
        if "seq" in rows.columns:
            met &= F.coalesce(F.col("_seq") <= F.col("seq"), F.lit(True))
        return rows.join(known, met, "left_anti")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Write the run of a batch, and merge runs where ``fan`` of one size are complete."""
        self._write(self._bucketed(rows), batch, batch + 1)
        size = 1
        while (batch + 1) % (size * self.fan) == 0:
            first = batch + 1 - size * self.fan
            parts = [(first + i * size, first + (i + 1) * size) for i in range(self.fan)]
            size *= self.fan
            self._write(self._read(parts), first, batch + 1)
