"""Offline evaluation of retrieval over a labelled query set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.operators.dense import knn_exact
from lodgelens.operators.embedding import Embedder, embed_text
from lodgelens.operators.evaluation import ir_metrics, macro_mean
from lodgelens.operators.fusion import reciprocal_rank_fusion
from lodgelens.operators.lexical import lexical_topk
from lodgelens.operators.rerank import RETRIEVE_K, SMALL_HITS
from lodgelens.sources.query_sets import read_query_set


def evaluate_retrieval(
    spark: SparkSession,
    query_set: str,
    chunks: DataFrame,
    mode: str = "dense",
    ks: tuple[int, ...] = (3, 5, 10),
    top_k: int = RETRIEVE_K,
    embedder: Embedder | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Metrics per query and their means for ``dense``, ``lexical`` or ``hybrid`` search."""
    queries, qrels = read_query_set(spark, query_set)
    labelled = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    found = []
    if mode in ("dense", "hybrid"):
        vectors = chunks if "embedding" in chunks.columns else embed_text(chunks, "chunk_text", embedder)
        found.append(knn_exact(embed_text(labelled, "query", embedder), vectors, top_k))
    if mode in ("lexical", "hybrid"):
        found.append(lexical_topk(labelled, chunks, top_k))
    hits = found[0] if len(found) == 1 else reciprocal_rank_fusion(*found, k=top_k)
    small = labelled.count() * top_k <= SMALL_HITS
    listings = chunks.select("chunk_id", "listing_id")
    with_listing = listings.join(F.broadcast(hits) if small else hits, "chunk_id")
    per_query = ir_metrics(with_listing, qrels, ks)
    return per_query, macro_mean(per_query)
