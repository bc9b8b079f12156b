"""One ranking out of several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.operators.ranking import top_per_key

# Reciprocal-rank constant: the usual default, a choice of this package.
RRF_CONSTANT = 60


def reciprocal_rank_fusion(*lists: DataFrame, k: int = 20, constant: int = RRF_CONSTANT) -> DataFrame:
    """Sum of ``1 / (constant + rank)`` over ranked lists of ``(query_id, chunk_id, rank)``.

    A union and one aggregate: a chunk missing from a list simply adds nothing. The lists
    hold a few hits per query; they are shuffled once, by query, for both steps.
    """
    gains = [
        hits.select("query_id", "chunk_id", (F.lit(1.0) / (F.col("rank") + constant)).alias("gain"))
        for hits in lists
    ]
    summed = (
        reduce(DataFrame.unionByName, gains)
        .repartition("query_id")
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum("gain"), 8).alias("score"))
    )
    top = top_per_key(summed, ["query_id"], [F.desc("score")], k, tie="chunk_id")
    return top.select("query_id", "rank", "chunk_id", "score")
