"""Second-stage scoring of (query, chunk) pairs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.text import words
from lodgelens.operators.ranking import top_per_key

# Default depths, and those of a question about a whole place.
RETRIEVE_K, RERANK_K = 20, 3
PLACE_RETRIEVE_K, PLACE_RERANK_K = 40, 8


class PairScorer(Protocol):
    """A plug-in model. ``load`` runs once per Python worker, ``score`` once per batch."""

    def load(self) -> None: ...

    def score(self, queries: list[str], texts: list[str]) -> np.ndarray: ...


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that occur in the text, to six places."""
    asked = F.array_distinct(words(query))
    shared = F.size(F.array_intersect(asked, words(text)))
    return F.round(F.coalesce(F.try_divide(shared, F.size(asked)), F.lit(0.0)), 6)


def _model_score(scorer: PairScorer, query: Column, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer.load()
        for queries, texts in batches:
            yield pd.Series(scorer.score(queries.tolist(), texts.tolist()), dtype=float)

    return score(query, text)


#: Hits are broadcast up to this many rows of ids, ranks and scores (some 100 bytes each).
SMALL_HITS = 200_000


def pair_join(
    hits: DataFrame, chunks: DataFrame, queries: DataFrame, depth: int | None = None
) -> DataFrame:
    """Add chunk columns and query text to hits.

    ``depth`` is the retrieval depth behind the hits. If queries times depth is small
    enough, the hits are broadcast and the wide chunk table is read in place; otherwise
    both sides are shuffled by chunk.
    """
    small = depth is not None and queries.count() * depth <= SMALL_HITS
    narrow = F.broadcast(hits) if small else hits
    return chunks.join(narrow, "chunk_id").join(queries.select("query_id", "query"), "query_id")


def rerank_topk(
    pairs: DataFrame,
    k: int | Column = RERANK_K,
    scorer: PairScorer | None = None,
    deepest: int | None = None,
) -> DataFrame:
    """Best ``k`` pairs per query by the scorer; ``k`` may be a column per query.

    The earlier rank breaks ties, as a stable sort would, then the chunk id.
    """
    query, text = F.col("query"), F.col("chunk_text")
    score = _model_score(scorer, query, text) if scorer else overlap_score(query, text)
    order = [F.desc("rerank_score"), F.asc("rank")]
    limit = k if isinstance(k, int) else (deepest or PLACE_RERANK_K)
    scored = pairs.withColumn("rerank_score", score)
    top = top_per_key(scored, ["query_id"], order, limit, tie="chunk_id", rank="rerank_rank")
    return top if isinstance(k, int) else top.filter(F.col("rerank_rank") <= k)
