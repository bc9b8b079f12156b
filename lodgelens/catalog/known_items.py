"""Known-item evaluation: benchmark passages as questions, texts that quote them as answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.catalog.registry import load
from lodgelens.functions.once import with_once
from lodgelens.functions.text import words
from lodgelens.operators.embedding import Embedder
from lodgelens.plans.evaluation import evaluate_retrieval
from lodgelens.session import scratch_path, spread_few_splits
from lodgelens.sources.query_sets import write_query_set

#: Words that must agree before a text is searched for the whole passage.
PROBE = 5


def quoted_passages(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, query, relevant_listing_ids)`` for every passage some document quotes.

    Documents and passages meet on the passage's first words; the quote is then checked
    in full. A passage is quoted by few documents, so its list stays short.
    """
    probe = F.array_join(F.slice(words(F.col("text")), 1, PROBE), " ")
    items = load(spark, folder, "benchmark").select("item_id", F.col("text").alias("query"), probe.alias("probe"))
    docs = spread_few_splits(load(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    split = with_once(docs, {"t": words(F.col("text"))})
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t") - (PROBE - 1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice("t", i, F.lit(PROBE)), " "))
    at = split.select("doc_id", F.explode(F.array_distinct(runs)).alias("probe"))
    met = at.join(items, "probe").join(docs, "doc_id")
    quoted = met.filter(F.col("text").contains(F.col("query")))
    return quoted.groupBy(F.col("item_id").cast("string").alias("id"), "query").agg(
        F.collect_set(F.col("doc_id").cast("string")).alias("relevant_listing_ids")
    )


def known_item_means(spark: SparkSession, folder: str, mode: str, embedder: Embedder | None = None) -> dict[str, float]:
    """Mean Recall, nDCG and MRR of one search mode."""
    path = scratch_path(spark, "known-items")
    write_query_set(quoted_passages(spark, folder), path)
    docs = load(spark, folder, "documents")
    chunks = docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").alias("listing_id"),
        F.col("text").alias("chunk_text"),
    )
    _, means = evaluate_retrieval(spark, path, chunks, mode, embedder=embedder)
    return means.first().asDict()
