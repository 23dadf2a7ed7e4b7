"""Task states with a timer: a task left in processing fails by itself once the event time has passed its deadline.

The order of a task's events is that of their time. An event that comes after the deadline finds the task failed, so a
late completion meets the guard; a task without further events is failed by a timer behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from articleflow.operators.tasks import STATES, TRANSITIONS
from articleflow.streaming.streams import each_batch

STATE = "status string, applied long, ignored long, stale long, updated_seq long, updated_us long"
ROWS = "task_id long, status string, applied long, ignored long, stale long, updated_seq long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class StaleTasks(StatefulProcessor):
    """Folds the events of one task; input has seq, event and us (microseconds of the event's time)."""

    def __init__(self, minutes: float):
        self.patience = int(minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", STATE)

    def _read(self) -> list:
        found = self.state.get()
        return list(found) if found is not None else [STATES[0], 0, 0, 0, None, 0]

    def _expire(self, now: list, us: int) -> None:
        if now[0] == "processing" and now[5] + self.patience < us:
            now[0], now[3] = "failed", now[3] + 1

    def _rows(self, key: tuple, now: list) -> Iterator[pd.DataFrame]:
        self.state.update(tuple(now))
        yield pd.DataFrame({name.split()[0]: [v] for name, v in zip(ROWS.split(", "), (key[0], *now[:5]), strict=True)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self._read()
        events = pd.concat(list(rows)).sort_values(["us", "seq"])
        for seq, event, us in zip(events["seq"].tolist(), events["event"].tolist(), events["us"].tolist(), strict=True):
            self._expire(now, us)
            needs, leads = TRANSITIONS.get(event, (None, None))
            if now[0] == needs:
                now[0], now[1], now[4], now[5] = leads, now[1] + 1, seq, us
            else:
                now[2] += 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now[0] == "processing":
            self.handle.registerTimer((now[5] + self.patience) // 1000 + 1)
        yield from self._rows(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._read()
        self._expire(now, timerValues.getCurrentWatermarkInMs() * 1000)
        yield from self._rows(key, now)

    def close(self) -> None:
        pass


def task_states_with_timer(stream: DataFrame, path: str, minutes: float = 10, delay: str = "10 minutes", ts: str = "at") -> DataFrame:
    """task_id, status, applied, ignored, stale, updated_seq from a stream of (task_id, seq, event, ``ts``).

    ``stale`` counts failures by the deadline. Events behind the watermark are dropped by Spark, so ``delay`` must cover how
    late events come. Every micro-batch writes the states it changed to its own folder; the last one of a task holds,
    and counters only grow, so a replayed batch changes nothing.
    """
    spark: SparkSession = stream.sparkSession
    folder = f"{path}/states"
    timed = stream.withWatermark(ts, delay).select("task_id", "seq", "event", ts, F.unix_micros(ts).alias("us"))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        states = timed.groupBy("task_id").transformWithStateInPandas(
            StaleTasks(minutes), outputStructType=ROWS, outputMode="Update", timeMode="EventTime"
        )
        each_batch(states, path, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}"), mode="update")
    finally:
        spark.conf.set(PROVIDER, before)
    order = F.struct("batch", F.expr("applied + ignored + stale").alias("n"))
    last = spark.read.schema(f"{ROWS}, batch long").parquet(folder).groupBy("task_id").agg(F.max_by(F.struct(*(c.split()[0] for c in ROWS.split(", ")[1:])), order).alias("s"))
    return last.select("task_id", "s.*")
