"""Positions and ordered folds that never put one key into one task.

A key may hold a third of all rows, so ``row_number() over (partition by key)`` and
``collect_list`` by key are out. Both operators cut a key's rows along their order into buckets,
work inside buckets, and then combine one small row per bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Merge = Callable[[Column, Column], Column]


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str = "pos",
) -> DataFrame:
    """1-based position among rows of equal ``keys`` in ``order`` (which must be total).

    ``bucket`` must never decrease along ``order``; it sets how finely a key is cut. Bucket
    sizes are a pre-aggregated table, so only one bucket of a key is ever sorted in a task.
    """
    keys = list(keys)
    cut = df.withColumn("_bucket", bucket)
    earlier = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        cut.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def _levels(df: DataFrame, seq: str, width: int) -> tuple[int, int]:
    """Least ``seq``, and how often the span above it must be divided by ``width``.

    Two numbers from a one-column scan decide how the fold is planned.
    """
    low, high = df.agg(F.min(seq), F.max(seq)).first()
    if low is None or low == high:
        return low or 0, 1
    return int(low), max(1, math.ceil(math.log(int(high) - int(low) + 1, width)))


def _combine(grouped_keys: list[str], df: DataFrame, merge: Merge) -> DataFrame:
    """One segment per group, merged in order; a group never exceeds the bucket width."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "_seg"))), lambda x: x["_seg"]
    )
    listed = df.groupBy(*grouped_keys).agg(ordered.alias("_list"))
    merged = F.reduce(
        F.slice(F.col("_list"), 2, F.greatest(F.size("_list") - 1, F.lit(0))),
        F.element_at("_list", 1),
        merge,
    )
    return listed.select(*grouped_keys, merged.alias("_seg"))


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    segment: Column,
    merge: Merge,
    name: str = "folded",
    width: int = 4096,
) -> DataFrame:
    """Fold each key's rows in ``seq`` order with an associative ``merge``.

    ``segment`` is one row's value. ``(key, seq)`` must be unique. Groups cover at most
    ``width`` sequence numbers; their results are folded again, as often as the span needs.
    """
    keys = list(keys)
    low, levels = _levels(df, seq, width)
    step = df.select(*keys, (F.col(seq).cast("long") - low).alias("_at"), segment.alias("_seg"))
    for level in range(levels):
        if level == levels - 1:
            step = _combine(keys, step, merge)
        else:
            step = step.withColumn("_chunk", F.expr(f"_at div {width}"))
            step = _combine([*keys, "_chunk"], step, merge).withColumnRenamed("_chunk", "_at")
    return step.withColumnRenamed("_seg", name)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    outcomes: Column,
    start: int = 0,
    name: str = "state_before",
    width: int = 256,
) -> DataFrame:
    """The automaton state each row meets, per key in ``seq`` order.

    ``outcomes`` is an integer array: entry ``s`` is the state after the row when it met state
    ``s``. Chunks are composed upwards, then replayed downwards from their true start states.
    """
    keys = list(keys)
    low, levels = _levels(df, seq, width)
    compose: Merge = lambda left, right: F.transform(left, lambda s: F.get(right, s))
    tiers = [df.select(*keys, (F.col(seq).cast("long") - low).alias("_at"), outcomes.alias("_seg"))]
    for _ in range(levels - 1):
        below = tiers[-1].withColumn("_chunk", F.expr(f"_at div {width}"))
        tiers.append(
            _combine([*keys, "_chunk"], below, compose).withColumnRenamed("_chunk", "_at")
        )

    def replay(tier: DataFrame, starts: DataFrame | None) -> DataFrame:
        group = keys if starts is None else [*keys, "_chunk"]
        if starts is not None:
            tier = tier.withColumn("_chunk", F.expr(f"_at div {width}"))
        listed = tier.groupBy(*group).agg(
            F.array_sort(F.collect_list(F.struct("_at", "_seg"))).alias("_list")
        )
        if starts is None:
            listed = listed.withColumn("_start", F.lit(start))
        else:
            listed = listed.join(starts.withColumnRenamed("_at", "_chunk"), group)
        walked = F.reduce(
            F.col("_list"),
            F.struct(F.col("_start").alias("s"), F.array().cast("array<struct<_at:bigint,_start:int>>").alias("out")),
            lambda acc, x: F.struct(
                F.get(x["_seg"], acc["s"]).alias("s"),
                F.concat(
                    acc["out"], F.array(F.struct(x["_at"].alias("_at"), acc["s"].alias("_start")))
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return listed.select(*keys, F.explode(walked).alias("_row")).select(
            *keys, "_row._at", "_row._start"
        )

    starts = None
    for tier in reversed(tiers):
        starts = replay(tier, starts)
    return starts.select(*keys, (F.col("_at") + low).alias(seq), F.col("_start").alias(name))
