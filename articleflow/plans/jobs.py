"""A worker round as one job: recover, ingest, summarise, count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.operators import ingest, quality, tasks
from articleflow.plans import summarise
from articleflow.session import cut_lineage
from articleflow.sources.versions import VersionedTables


@dataclass
class Round:
    """Table versions and counts after a round; phases that were skipped have no counts."""

    articles: DataFrame
    favorites: DataFrame
    feedback: DataFrame
    crawl_stats: DataFrame | None = None
    summary_stats: DataFrame | None = None

    def write(self, path: str, after: int | None = None) -> int:
        """All three tables as one new version of ``VersionedTables``: a delete reaches all of them or none."""
        tables = {name: getattr(self, name) for name in ("articles", "favorites", "feedback")}
        return VersionedTables(self.articles.sparkSession, path).publish(tables, after)


def run_round(
    articles: DataFrame,
    favorites: DataFrame,
    feedback: DataFrame,
    fetched: list[DataFrame],
    as_of: Column,
    batch_limit: int | None = 50,
    stale_minutes: int = 10,
    skip_crawl: bool = False,
    skip_summary: bool = False,
    domain=quality.CATEGORIES,
    make_predict=None,
    model_version: str = "extractive-v1",
    token_count: Column | None = None,
    **options,
) -> Round:
    """One round over the three tables; ``fetched`` are article rows, one frame per source with its own ``seq``.

    The summary phase deletes articles above the model's limit, so it wants their ``token_count`` as the model
    counts; characters are no stand-in. ``batch_limit`` None claims every pending article.
    """
    if not skip_summary and token_count is None:
        raise ValueError("token_count: a column with the model's token count of an article")
    current = tasks.recover_stale(articles, as_of, stale_minutes)
    result = Round(current, favorites, feedback)
    if not skip_crawl and fetched:
        arrived = ingest.union_sources(fetched)
        judged = ingest.outcomes(arrived, current, domain)
        result.crawl_stats = ingest.stats(judged)
        keys = ingest.place(arrived)
        created = judged.where("outcome = 'created'").select(*keys)
        fresh = ingest.with_hash(arrived).join(created, keys, "left_semi")
        result.articles = ingest.append(fresh, current, as_of)
    if not skip_summary:
        # only ids and finished summaries are written down; bodies of all other articles stay where they are
        chosen = cut_lineage(tasks.claimable(result.articles, batch_limit))
        mine = result.articles.join(chosen, "id", "left_semi")
        claimed = tasks.mark_claimed(result.articles, chosen, as_of)
        drafts = summarise.extractive(mine.withColumn("token_count", token_count), **options)
        made = cut_lineage(summarise.gate(summarise.batch(drafts, make_predict, model_version)))
        result.summary_stats = tasks.stats(made)
        done = tasks.apply(claimed, made.where("outcome <> 'too_long'"), as_of)
        result.articles, result.favorites, result.feedback, _ = tasks.delete_unprocessable(
            done, favorites, feedback, made.where("outcome = 'too_long'").select("id")
        )
    return result
