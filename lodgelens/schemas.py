"""Canonical schemas, applied by column name."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
}


def flat_schema(spec: str) -> T.StructType:
    """Schema of ``name type`` pairs; needs no running session, unlike a DDL parse."""
    pairs = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Column names and types of the three CSV exports.
LISTINGS = flat_schema(
    "id long, name string, host_id long, host_name string, neighbourhood_group string, "
    "neighbourhood string, latitude double, longitude double, room_type string, price string, "
    "minimum_nights int, number_of_reviews int, last_review string, reviews_per_month double, "
    "calculated_host_listings_count int, availability_365 int, number_of_reviews_ltm int, "
    "license string"
)
REVIEWS = flat_schema(
    "listing_id long, id long, date string, reviewer_id long, reviewer_name string, comments string"
)
NEIGHBOURHOODS = flat_schema("neighbourhood_group string, neighbourhood string")

CHUNKS = flat_schema(
    "chunk_id string, listing_id long, city string, neighbourhood string, room_type string, "
    "review_date string, chunk_text string, token_count int"
)
#: Columns the retrieval index keeps of a chunk.
INDEXED_COLUMNS = [
    "chunk_id",
    "listing_id",
    "city",
    "neighbourhood",
    "room_type",
    "review_date",
    "chunk_text",
]

QUERY_SET = T.StructType(
    [
        T.StructField("_comment", T.StringType()),
        T.StructField(
            "queries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("query", T.StringType()),
                        T.StructField("relevant_listing_ids", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)

METRIC_STATE = T.StructType(
    [
        T.StructField("intent_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("cache_hits", T.LongType()),
        T.StructField("cache_misses", T.LongType()),
        T.StructField("errors", T.MapType(T.StringType(), T.LongType())),
        T.StructField("phase_timings", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))),
    ]
)

SCOPE = flat_schema("kind string, listing_id long, neighbourhood string, label string")
