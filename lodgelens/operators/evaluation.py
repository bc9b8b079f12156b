"""Retrieval and judge metrics over whole query sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.functions.replies import judge_score
from lodgelens.functions.values import id_normalise


def rank_hits(hits: DataFrame, order: list[Column]) -> DataFrame:
    """Number the hits of each query from 1; a query has at most its retrieval depth of them."""
    return hits.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    )


def join_qrels(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Mark each hit 1 or 0: is its listing among the query's relevant ones?

    ``qrels`` holds normalised text ids, one row per query and listing.
    """
    labelled = hits.withColumn("listing_id", id_normalise(F.col("listing_id")))
    marks = qrels.select("query_id", "listing_id", F.lit(1).alias("rel"))
    return labelled.join(marks, ["query_id", "listing_id"], "left").fillna({"rel": 0})


def _ideal(n_relevant: Column, k: int) -> Column:
    """Best possible gain: all relevant listings first, cut at ``k``."""
    steps = [1.0 / math.log2(i + 1) for i in range(1, k + 1)]
    sums = F.array(*[F.lit(sum(steps[: i + 1])) for i in range(k)])
    return F.element_at(sums, F.least(n_relevant, F.lit(k)).cast("int"))


def dcg_discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1))


def ir_metrics(hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """One row per labelled query: recall, nDCG (both forms) per ``k``, and MRR.

    ``hits`` are ``(query_id, rank, listing_id)``. ``ndcg_chunk`` adds gain for every chunk
    of a relevant listing, so it may exceed 1; ``ndcg_listing`` ranks each listing once.
    MRR looks at all hits. Queries without hits score 0, queries without labels are left out.
    """
    relevant = qrels.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    per_listing = Window.partitionBy("query_id", "listing_id").orderBy("rank")
    in_query = Window.partitionBy("query_id").orderBy("rank")
    marked = (
        join_qrels(hits, qrels)
        .withColumn("first", (F.row_number().over(per_listing) == 1).cast("int"))
        .withColumn("listing_rank", F.sum("first").over(in_query))
    )
    rel, rank = F.col("rel"), F.col("rank")
    new_rel = rel * F.col("first")
    measures = [F.max(F.when(rel == 1, 1.0 / rank)).alias("mrr")]
    for k in ks:
        listing_rank = F.col("listing_rank")
        measures += [
            F.sum(F.when(rank <= k, new_rel)).alias(f"found_{k}"),
            F.sum(F.when(rank <= k, rel * dcg_discount(rank))).alias(f"dcg_chunk_{k}"),
            F.sum(
                F.when(listing_rank <= k, new_rel * dcg_discount(listing_rank))
            ).alias(f"dcg_listing_{k}"),
        ]
    summed = marked.groupBy("query_id").agg(*measures)
    joined = relevant.join(summed, "query_id", "left").fillna(0)
    out = ["query_id", "n_relevant", "mrr"]
    for k in ks:
        ideal = _ideal(F.col("n_relevant"), k)
        out += [
            (F.col(f"found_{k}") / F.col("n_relevant")).alias(f"recall_{k}"),
            (F.col(f"dcg_chunk_{k}") / ideal).alias(f"ndcg_chunk_{k}"),
            (F.col(f"dcg_listing_{k}") / ideal).alias(f"ndcg_listing_{k}"),
        ]
    return joined.select(*out)


def macro_mean(per_query: DataFrame, digits: int = 4) -> DataFrame:
    """Rounded mean of every metric column over queries, 0 when there are none."""
    names = [c for c in per_query.columns if c not in ("query_id", "n_relevant")]
    means = [F.bround(F.coalesce(F.avg(c), F.lit(0.0)), digits).alias(c) for c in names]
    return per_query.agg(*means, F.count("*").alias("n_queries"))


def mean_skip_missing(df: DataFrame, *columns: str, digits: int = 3) -> DataFrame:
    """Rounded means that skip missing values; ``n`` counts all rows."""
    means = [F.bround(F.avg(c), digits).alias(f"avg_{c}") for c in columns]
    return df.agg(*means, F.count("*").alias("n"))


def judge_scores(replies: DataFrame, raw: str = "raw") -> DataFrame:
    return replies.withColumns(
        {name: judge_score(F.col(raw), name) for name in ("faithfulness", "relevance")}
    )


def judge_summary(replies: DataFrame, raw: str = "raw") -> DataFrame:
    return mean_skip_missing(judge_scores(replies, raw), "faithfulness", "relevance")
