"""Bronze rows to silver rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.language import with_language
from lodgelens.functions.once import with_once
from lodgelens.functions.text import normalise_name, squash_space, strip_tags
from lodgelens.functions.values import PRICE_MAX, PRICE_MIN, parse_price, range_to_null
from lodgelens.operators.ranking import keep_first

# Languages whose reviews are kept.
KEPT_LANGUAGES = ("en", "it")


def with_place_names(df: DataFrame) -> DataFrame:
    """Fold both place columns; the raw name stays for display."""
    return df.withColumns(
        {
            "neighbourhood_display": F.col("neighbourhood"),
            "neighbourhood": normalise_name(F.col("neighbourhood")),
            "neighbourhood_group": normalise_name(F.col("neighbourhood_group")),
        }
    )


def silver_listings(bronze: DataFrame, low: float = PRICE_MIN, high: float = PRICE_MAX) -> DataFrame:
    """Typed price within range; rows without a price or a room type are dropped."""
    parsed = with_once(bronze, {"price": parse_price(F.col("price"))})
    priced = parsed.withColumn("price", range_to_null(F.col("price"), low, high))
    return with_place_names(priced).dropna(subset=["price", "room_type"])


def silver_neighbourhoods(bronze: DataFrame) -> DataFrame:
    """One row per city and folded name; the first display name in order wins."""
    order = [F.col("neighbourhood_display"), F.col("neighbourhood_group")]
    return keep_first(with_place_names(bronze), ["city", "neighbourhood"], order)


def clean_comments(df: DataFrame, text: str = "comments") -> DataFrame:
    """Tags and runs of white space become one blank; blank texts are dropped."""
    cleaned = with_once(df, {text: squash_space(strip_tags(F.col(text)))})
    return cleaned.filter(F.length(text) > 0)


def silver_reviews(
    bronze: DataFrame, languages: tuple[str, ...] = KEPT_LANGUAGES, detector=None
) -> DataFrame:
    """Clean text in the kept languages, one review per listing, reviewer and date."""
    spoken = with_language(clean_comments(bronze), "comments", detector=detector)
    kept = spoken.filter(F.col("lang").isin(*languages))
    return keep_first(kept, ["listing_id", "reviewer_id", "date"], [F.col("id"), F.col("comments")])
