"""Token counts of whole texts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from articleflow.llm.common import map_texts
from articleflow.llm.transducer import Counter, Vocabulary


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One per worker process; a worker that is lost costs a new compilation, nothing else."""
    return Counter(Vocabulary.from_model(path))


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit.

    Null texts count as empty: no bytes, no tokens. Repeated rows are counted one by one; other columns are
    not read. ``model_path`` must exist on every executor.
    """
    ddl = f"{key} long, n_bytes long, n_tokens long, over_limit boolean"

    def rows(keys: list, texts: list) -> dict[str, list]:
        count = counter(model_path).count
        tokens = [count(t) for t in texts]
        return {
            key: keys, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    return map_texts(documents, key, text, ddl, rows)
