"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights of the cells (source, language, topic) are raked to each margin in turn. A document's rate is its
cell's weight per token; a common scale turns rates into probabilities that spend the token budget.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.llm.common import staged

MARGINS = ("source", "lang", "topic")
#: A number tempers the present shares (share ** number); a mapping gives shares, and the values it does
#: not name divide what is left by their tokens.
Target = float | Mapping[str, float]
#: Production targets and budget.
TARGETS: dict[str, Target] = {"source": 0.5, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1}, "topic": 0.7}
BUDGET = 0.5
SEED = "mix-1"
ROUNDS = 12
#: A last step that is farther from one than this is reported.
LOOSE = 1e-3


def topic(text: Column) -> Column:
    """A coarse topic from cues in the whole text."""
    has = lambda *cues: F.greatest(*(F.contains(text, F.lit(c)) for c in cues)) if len(cues) > 1 else F.contains(text, F.lit(cues[0]))
    return (
        F.when(has("password", "secret", "AKIA"), "credentials").when(has("icense", "opyright"), "licence")
        .when(has("@"), "contact").when(has(" | "), "tabular").otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Words between blanks, and one for the end, so no document weighs nothing."""
    return (F.size(F.array_remove(F.split(F.translate(text, "\t\n\v\f\r", "     "), " "), "")) + 1).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens; a null source or language is ``unknown``, a null text empty."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"), topic(text).alias("topic"), tokens(text).alias("n_tokens"),
    )


def _shares(cells: DataFrame, margin: str, target: Target) -> DataFrame:
    """margin value and its target share; shares of values that occur sum to one."""
    present = cells.groupBy(margin).agg(F.sum("n").alias("_n"))
    if isinstance(target, Mapping):
        given = F.create_map(*(F.lit(x) for pair in target.items() for x in pair))
        named, left = F.col(margin).isin(*target), max(0.0, 1.0 - sum(target.values()))
        others = present.agg(F.sum(F.when(~named, F.col("_n")))).first()[0] or 1
        raw = F.when(named, given[F.col(margin)]).otherwise(left * F.col("_n") / F.lit(others))
    else:
        raw = F.pow(F.col("_n").cast("double"), F.lit(float(target)))
    raw = present.select(margin, raw.alias("_raw"))
    whole = raw.agg(F.sum("_raw")).first()[0] or 1.0
    return raw.select(margin, (F.col("_raw") / F.lit(whole)).alias("_share"))


def rake(cells: DataFrame, targets: Mapping[str, Target], rounds: int = ROUNDS, tolerance: float = 1e-10) -> DataFrame:
    """``cells`` (the margins and ``n`` tokens) with ``weight``: shares that meet all targets, as near as cells allow.

    A round is three window sums over the cells, which are aggregated and few. Targets that the cells cannot meet
    together leave the weights of the last round, with a warning that says how far off they are.
    """
    now = cells.withColumn("weight", F.col("n").cast("double"))
    for m, t in targets.items():
        now = now.join(_shares(cells, m, t).withColumnRenamed("_share", f"_{m}"), m)
    now, worst = staged(now, "mix-cells"), None
    for _ in range(rounds):
        off = F.lit(0.0)
        stepped = now
        for m in targets:
            total = F.sum("weight").over(Window.partitionBy(m))
            stepped = stepped.withColumn("_step", F.when(total > 0, F.col(f"_{m}") / total).otherwise(0.0))
            off = F.greatest(F.col("_off") if "_off" in stepped.columns else off, F.abs(F.col("_step") - 1))
            stepped = stepped.withColumns({"weight": F.col("weight") * F.col("_step"), "_off": off}).drop("_step")
        seen = Observation()
        now = staged(stepped.observe(seen, F.max("_off").alias("worst")).drop("_off"), "mix-cells")
        worst = seen.get["worst"]
        if worst is None or worst < tolerance:
            break
    if worst is not None and worst > LOOSE:
        warnings.warn(f"raking stopped after {rounds} rounds, {worst:.2g} off its targets", stacklevel=2)
    return now.select(*targets, "n", "weight")


def scale(cells: DataFrame, budget: float) -> float:
    """The factor of rates (weight / n) at which probabilities capped at one spend ``budget`` tokens."""
    factor, rate = 0.0, F.col("weight") / F.col("n")
    while True:
        full = rate * F.lit(factor) >= 1
        spent, open_weight = cells.agg(
            F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if open_weight <= 0:
            return factor
        after = (budget - spent) / open_weight
        if after <= factor * (1 + 1e-12):
            return factor
        factor = after


def rates(docs: DataFrame, targets: Mapping[str, Target] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """The margins of each cell of ``measured`` documents, its weight and the probability of its documents.

    ``budget`` is a share of all tokens. Cells are aggregated before they are shuffled; one source may hold any
    share of the rows.
    """
    cells = staged(docs.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")), "mix-counts")
    raked = rake(cells, targets)
    total = cells.agg(F.sum("n")).first()[0] or 0
    factor = scale(raked, budget * total)
    chance = F.least(F.lit(1.0), F.lit(factor) * F.col("weight") / F.col("n"))
    return raked.select(*MARGINS, "weight", chance.alias("probability"))


def mix(
    documents: DataFrame, targets: Mapping[str, Target] = TARGETS, budget: float = BUDGET, seed: str = SEED
) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, probability, sampled.

    Draws depend on the id and the seed alone, so repeated rows share their fate, and a sample is the same in
    any partitioning. Other columns are not read.
    """
    docs = staged(measured(documents), "mix-docs")
    return docs.join(rates(docs, targets, budget), list(MARGINS)).select(
        "doc_id", *MARGINS, "n_tokens", "weight", "probability", (draw(F.col("doc_id"), seed) < F.col("probability")).alias("sampled")
    )


def sample(
    documents: DataFrame, targets: Mapping[str, Target] = TARGETS, budget: float = BUDGET, seed: str = SEED
) -> DataFrame:
    """The documents that ``mix`` draws, with the columns they have."""
    names = {m: f"_{m}" for m in MARGINS}
    known = staged(rates(measured(documents), targets, budget), "mix-rates").drop("weight").withColumnsRenamed({**names, "probability": "_p"})
    keyed = documents.withColumns({
        "_source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")),
        "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")),
        "_topic": topic(F.coalesce("text", F.lit(""))),
    })
    drawn = keyed.join(known, list(names.values())).where(draw(F.col("doc_id"), seed) < F.col("_p"))
    return drawn.select(documents.columns)
