"""Exact distributions and rolling means that scale with the data, not with the largest group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.operators.ordering import position
from articleflow.session import cut_lineage

QUANTILES = {"median": 0.5, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
BASIC = ["median", "p90", "p95", "p99"]
EXTENDED = ["median", "p50", "p75", "p90", "p95", "p99"]
ACCURACY = 10_000
GRID = 512
MOST = 100_000
FACTS = ["n", "low", "high", "mean"]


def quantiles(
    df: DataFrame, value: str, ratios: Sequence[float], by: Sequence[str] = (), most: int = MOST
) -> DataFrame:
    """(by..., ratio, quantile, n, low, high, mean): exact, linearly interpolated.

    A sketch (bounded size, combined map-side) brackets every wanted rank; brackets that may hold more than
    ``most`` rows are narrowed in further passes. Value counts outside a bracket collapse into one row each
    side, so only the few values around a rank are sorted. A rank outside its bracket is an error. Sketches are
    made at once, the quantiles when the result is used. Groups with a null key take no part.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    return _select(rows, brackets(rows, ratios, by, most), by)


def brackets(rows: DataFrame, ratios: Sequence[float], by: Sequence[str], most: int = MOST) -> DataFrame:
    """(by..., _w): facts of each group of ``_v`` and, per ratio, values that enclose its rank.

    Strictly between the two lie at most about ``most`` rows: each pass cuts them to four steps of a grid.
    """
    ratios = sorted(set(ratios))
    margin = 2.0 / ACCURACY
    edges = [max(r - margin, 0.0) for r in ratios] + [min(r + margin, 1.0) for r in ratios]
    totals = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_v").alias("low"),
        F.max("_v").alias("high"),
        F.avg("_v").alias("mean"),
        F.percentile_approx("_v", [float(e) for e in edges], ACCURACY).alias("_edges"),
    )
    first = F.array(
        *[
            F.struct(
                F.lit(float(r)).alias("ratio"),
                F.get("_edges", F.lit(i)).alias("from"),
                F.get("_edges", F.lit(i + len(ratios))).alias("to"),
                (F.col("n") * (2 * margin)).alias("inside"),
            )
            for i, r in enumerate(ratios)
        ]
    )
    state = cut_lineage(totals.select(*by, F.struct(*FACTS, first.alias("_t")).alias("_w")))
    wide = lambda t: (t["inside"] > most) & (t["from"] < t["to"])
    known = " and ".join(["true", *(f"`{k}` is not null" for k in by)])
    while True:
        open_groups = state.where(known).where(F.exists("_w._t", wide))
        if open_groups.isEmpty():
            return state
        found = _narrower(rows, open_groups, by, wide)
        met = state.join(found, list(by), "left") if by else state.withColumn("_m", found.scalar())
        narrowed = F.transform("_w._t", lambda t: F.coalesce(F.element_at("_m", t["ratio"]), t))
        state = cut_lineage(met.select(*by, F.col("_w").withField("_t", narrowed).alias("_w")))


def _meet(rows: DataFrame, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.join(wanted, list(by)) if by else rows.withColumn("_w", wanted.select("_w").scalar())


def _narrower(rows: DataFrame, wanted: DataFrame, by: Sequence[str], wide: Callable[[Column], Column]) -> DataFrame:
    """(by..., _m): a map from ratio to its next bracket, for the brackets that are too wide."""
    v, start, end = F.col("_v"), F.col("_t.from"), F.col("_t.to")
    group = [*by, "_n", "_t"]
    seen = (
        _meet(rows, wanted, by)
        .select(*by, "_v", F.col("_w.n").alias("_n"), F.explode(F.filter("_w._t", wide)).alias("_t"))
        .groupBy(*group)
        .agg(
            F.count_if(v < start).alias("_below"),
            F.count_if(v == start).alias("_at"),
            F.count_if((v > start) & (v < end)).alias("_in"),
            F.percentile_approx(F.when((v > start) & (v < end), v), [i / GRID for i in range(GRID + 1)], ACCURACY).alias("_g"),
        )
    )
    place = (F.col("_n") - 1) * F.col("_t.ratio")
    step = lambda rank: (rank - F.col("_below") - F.col("_at")) * GRID / F.greatest("_in", F.lit(1))
    low, high = F.floor(step(F.floor(place))) - 1, F.ceil(step(F.ceil(place))) + 1
    known = lambda i: F.get("_g", i.cast("int"))
    after = F.floor(place) >= F.col("_below") + F.col("_at") + F.col("_in")
    before = F.ceil(place) < F.col("_below") + F.col("_at")
    fresh = F.struct(
        F.col("_t.ratio").alias("ratio"),
        F.when(after, end).when(low > 0, F.coalesce(known(low), start)).otherwise(start).alias("from"),
        F.when(before, start).when(high < GRID, F.coalesce(known(high), end)).otherwise(end).alias("to"),
        (F.col("_in") * (F.least(high, F.lit(GRID)) - F.greatest(low, F.lit(0))) / GRID).cast("double").alias("inside"),
    )
    entry = F.struct(F.col("_t.ratio").alias("key"), fresh.alias("value"))
    return seen.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))


def _select(rows: DataFrame, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """The values at the wanted ranks, from value counts inside the brackets."""
    met = _meet(rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), wanted, by)
    met = met.select(*by, "_v", "_c", *[F.col(f"_w.{f}") for f in FACTS], F.explode("_w._t").alias("_t"))
    side = F.when(F.col("_v") < F.col("_t.from"), -1).when(F.col("_v") > F.col("_t.to"), 1).otherwise(0)
    met = met.withColumn("_side", side)
    group = [*by, *FACTS, "ratio"]
    slots = (
        met.withColumn("ratio", F.col("_t.ratio"))
        .groupBy(*group, "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_slot"))
        .agg(
            F.sum("_c").alias("_c"),
            F.when(F.col("_side") < 0, F.max("_v")).otherwise(F.min("_v")).alias("_v"),
        )
    )
    line = Window.partitionBy(*by, "ratio").orderBy("_side", "_v")
    upto = F.sum("_c").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = (F.col("n") - 1) * F.col("ratio")
    below, above = F.floor(place), F.ceil(place)

    def at(rank: Column) -> Column:
        """Value whose run holds the rank. Of the rows outside only the nearest value is known."""
        first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
        unknown = ((F.col("_side") < 0) & (rank < last)) | ((F.col("_side") > 0) & (rank > first))
        lost = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
        return F.max(F.when((rank >= first) & (rank <= last), F.when(unknown, lost).otherwise(F.col("_v"))))

    return (
        slots.withColumn("_upto", upto)
        .groupBy(*group)
        .agg(at(below).alias("_below"), at(above).alias("_above"))
        .select(
            *by,
            "ratio",
            (F.col("_below") + (F.col("_above") - F.col("_below")) * (place - below)).alias("quantile"),
            "n",
            "low",
            "high",
            "mean",
        )
    )


def distribution(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), extended: bool = False
) -> DataFrame:
    """(by..., metric, count, min, mean, quantiles..., max), one row per group and column.

    A group, or a whole table, without values of a column has count 0 and nulls.
    """
    by = list(by)
    names = EXTENDED if extended else BASIC
    # one key that is never null, so a group of nulls is a group like others
    group = F.struct(F.lit(0).alias("_"), *by).alias("_group")
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        "_group", list(cols), "metric", "_value"
    )
    found = quantiles(long, "_value", [QUANTILES[n] for n in names], ["_group", "metric"])
    picks = [
        F.max(F.when(F.col("ratio") == QUANTILES[n], F.col("quantile"))).alias(n) for n in names
    ]
    measured = found.groupBy("_group", "metric").agg(
        F.first("n").alias("count"),
        F.first("low").alias("min"),
        F.first("mean").alias("mean"),
        *picks,
        F.first("high").alias("max"),
    )
    metrics = F.explode(F.array(*map(F.lit, cols))).alias("metric")
    groups = df.select(group).distinct() if by else df.sparkSession.range(1).select(group)
    every = groups.select("_group", metrics)
    names = [c for c in measured.columns if c not in ("_group", "metric", "count")]
    return every.join(measured, ["_group", "metric"], "left").select(
        *(F.col(f"_group.{k}").alias(k) for k in by), "metric", F.coalesce("count", F.lit(0)).alias("count"), *names
    )


def rolling_mean(
    df: DataFrame,
    run: str,
    step: str,
    value: str,
    size: int = 100,
    every: int = 100,
    width: int = 10_000,
) -> DataFrame:
    """Mean of the last ``size`` rows of a run, reported after every ``every`` rows.

    Every row is sent to the reports it belongs to and averaged with map-side combine, so a run
    that holds most of the log is spread over its reports.
    """
    placed = position(
        df.select(run, step, value), [run], [F.col(step)], F.floor(F.col(step) / width), "_row"
    )
    first = F.ceil(F.col("_row") / every)
    last = F.floor((F.col("_row") + size - 1) / every)
    sent = placed.where(last >= first).select(
        run, F.explode(F.sequence(first, last)).alias("_report"), "_row", value
    )
    return (
        sent.groupBy(run, "_report")
        .agg(F.avg(value).alias("rolling_mean"), F.max("_row").alias("_seen"))
        .where(F.col("_seen") == F.col("_report") * every)
        .select(run, (F.col("_report") * every).alias("rows_seen"), "rolling_mean")
    )
