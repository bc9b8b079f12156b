"""The denormalised listing view and the listing rows behind the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enriched_listings(listings: DataFrame, neighbourhoods: DataFrame) -> DataFrame:
    """Listings with the official names of their place, if it is known."""
    official = neighbourhoods.select(
        "city",
        "neighbourhood",
        F.col("neighbourhood_group").alias("official_neighbourhood_group"),
        F.col("neighbourhood_display").alias("official_neighbourhood_display"),
    )
    return listings.join(official, ["city", "neighbourhood"], "left")


def register_view(df: DataFrame, name: str = "listings_enriched") -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def place_names(enriched: DataFrame, column: str = "neighbourhood_display") -> DataFrame:
    """Sorted distinct names, nulls left out."""
    return enriched.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def reviewed_listings(enriched: DataFrame, chunks: DataFrame) -> DataFrame:
    """Located listings with at least one chunk, ids as text for clients without 64-bit integers.

    The chunk side is reduced to distinct ids before its shuffle: a join cannot split a
    hot listing on the right side of a semi join.
    """
    chunked = chunks.select(F.col("listing_id").alias("id")).distinct()
    with_chunks = enriched.filter(F.col("latitude").isNotNull()).join(chunked, "id", "left_semi")
    return with_chunks.select(
        F.col("id").cast("string").alias("id"),
        "name",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        "room_type",
        "price",
        F.col("neighbourhood_display").alias("neighbourhood"),
    ).distinct()
