"""Stratified review sample: the K busiest listings per place, N newest reviews each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.bounds import broadcast_if_small
from lodgelens.operators.ranking import top_per_key

# Default sample sizes.
REVIEWS_PER_LISTING = 6
LISTINGS_PER_PLACE = 150


def busiest_listings(listings: DataFrame, k: int = LISTINGS_PER_PLACE) -> DataFrame:
    """``listing_id`` of the ``k`` most reviewed listings per raw place name."""
    reviewed = listings.filter(F.col("number_of_reviews") > 0).select(
        "id", "neighbourhood", "number_of_reviews"
    )
    top = top_per_key(reviewed, ["neighbourhood"], [F.desc("number_of_reviews")], k, tie="id")
    return top.select(F.col("id").alias("listing_id"))


def reviews_of(reviews: DataFrame, target: DataFrame) -> DataFrame:
    """Reviews of the target listings.

    A semi join, as target ids are unique. With a small target the reviews are filtered
    in place; otherwise both sides hash on ``listing_id``, which the newest-N step reuses.
    """
    return reviews.join(broadcast_if_small(target), "listing_id", "left_semi")


def newest_reviews(reviews: DataFrame, n: int = REVIEWS_PER_LISTING) -> DataFrame:
    """The ``n`` newest reviews per listing. Later cleaning may leave fewer."""
    return top_per_key(reviews, ["listing_id"], [F.desc("date")], n, tie="id").drop("rank")


def stratified_reviews(
    listings: DataFrame,
    reviews: DataFrame,
    k: int = LISTINGS_PER_PLACE,
    n: int = REVIEWS_PER_LISTING,
) -> DataFrame:
    return newest_reviews(reviews_of(reviews, busiest_listings(listings, k)), n)
