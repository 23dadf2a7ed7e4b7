"""Samples that do not depend on input order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.functions.text import sha256
from articleflow.operators.corpus import identity
from articleflow.operators.stats import quantiles

# Fixed value: the method text of sample records.
METHOD = "SHA256(seed + ':' + stable_sample_id) ascending"


def selection_hash(key: Column, seed: str) -> Column:
    return sha256(F.concat(F.lit(f"{seed}:"), key))


def by_hash(
    df: DataFrame, n: int, seed: str, item_id: str = "id", article: str = "article", reference: str = "reference"
) -> DataFrame:
    """The first ``n`` rows by (seeded hash of the identity, identity, content hash): a top-k."""
    if n <= 0:
        raise ValueError("sample size must be positive")
    who = identity(F.col(item_id), F.col(article), F.col(reference))
    content = sha256(F.concat(F.col(article), F.lit("\n"), F.col(reference)))
    return df.orderBy(selection_hash(who, seed), who, content).limit(n)


def manifest(sample: DataFrame, counts: DataFrame, n: int, seed: str, item_id: str = "id") -> DataFrame:
    """One row about a sample of at most ``n`` rows, with its selected ids."""
    ids = F.array_sort(F.collect_list(F.col(item_id).cast("string")))
    facts = sample.agg(
        F.count(F.lit(1)).alias("sample_size_actual"), F.array_join(ids, ",").alias("selected_ids")
    )
    return facts.select(
        F.lit(seed).alias("seed"),
        F.lit(METHOD).alias("selection_method"),
        F.lit(n).cast("long").alias("sample_size_requested"),
        "sample_size_actual",
        *[counts.select(c).scalar().alias(c) for c in ("full_count", "eligible_count", "excluded_count")],
        "selected_ids",
    )


def uniform(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """A uniform sample of ``n`` rows: top-k of a seeded hash of the key."""
    return df.orderBy(selection_hash(F.col(key).cast("string"), str(seed)), key).limit(n)


def around_quantiles(
    df: DataFrame,
    value: str,
    index: str,
    seed: int = 42,
    ratios: Sequence[float] = (0.5, 0.75, 0.9),
    near: int = 128,
    picks: int = 8,
    stress: int = 32,
    upper: int = 512,
    widths: Sequence[int] = (32, 64),
) -> DataFrame:
    """Rows near chosen quantiles and rows just below the upper bound, as (index, value, kind).

    Each neighbourhood is a top-``near`` by distance; of those, ``picks`` are taken by seeded
    hash. The stress set comes from the narrowest band below ``upper`` with enough rows; without one the
    result is an error. All neighbourhoods and bands are ranked in one scan, and a task keeps no more of one than
    its limit (bounded by ``spark.sql.optimizer.windowGroupLimitThreshold``); the choice is made among those few.
    """
    most = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if max(near, stress) > most:
        raise ValueError(f"neighbourhoods of more than {most} rows would be sorted whole")
    rows = df.select(F.col(index).alias("index"), F.col(value).alias("value"))
    hashed = selection_hash(F.col("index").cast("string"), str(seed))
    entries = F.collect_list(F.struct("ratio", "quantile"))
    goals = quantiles(rows, "value", ratios).agg(F.map_from_entries(entries)).scalar()
    targets = {f"p{int(r * 100)}": F.abs(F.col("value") - F.element_at("_goals", F.lit(float(r)))) for r in ratios}
    bands = {f"within_{w}": F.col("value").between(upper - w, upper - 1) for w in widths}
    place = lambda kind, gap, key: F.struct(F.lit(kind).alias("kind"), gap.alias("gap"), key.alias("key"))
    offers = F.array(
        *[place(kind, gap.cast("double"), F.lit("")) for kind, gap in targets.items()],
        *[F.when(inside, place(kind, F.lit(0.0), hashed)) for kind, inside in bands.items()],
    )
    offered = (
        rows.where("value is not null")
        .withColumn("_goals", goals)
        .select("index", "value", F.explode(offers).alias("_o"))
        .where("_o is not null")
        .select("index", "value", "_o.*")
    )
    line = Window.partitionBy("kind").orderBy("gap", "key", "index")
    top = (
        offered.withColumn("_n", F.row_number().over(line))
        .where(F.col("_n") <= max(near, stress))
        .where(F.col("_n") <= F.when(F.col("kind").isin(*bands), stress).otherwise(near))
    )
    entry = F.struct(hashed.alias("hash"), "index", "value", "kind")
    state = top.agg(F.array_sort(F.collect_list(entry)).alias("_c")).withColumn("_p", F.slice("_c", 1, 0))
    of_kind = lambda kind: F.filter("_c", lambda c: c["kind"] == kind)
    for kind in targets:
        free = F.filter(of_kind(kind), lambda c: ~F.exists("_p", lambda p: p["index"].eqNullSafe(c["index"])))
        state = state.withColumn("_p", F.concat("_p", F.slice(free, 1, picks)))
    full = [of_kind(kind) for kind in bands]
    none = F.raise_error(F.lit(f"fewer than {stress} rows within {max(widths)} of the upper bound"))
    band = F.coalesce(*[F.when(F.size(b) >= stress, b) for b in full], none)
    return state.select(F.inline(F.concat("_p", band))).select(
        F.col("index").alias(index), F.col("value").alias(value), "kind"
    )
