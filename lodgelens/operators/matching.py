"""Places and listings named in a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.bounds import broadcast_if_small
from lodgelens.functions.text import letter_words, ngrams, words
from lodgelens.functions.values import distinctive_place_token


def match_places(
    utterances: DataFrame, places: DataFrame, key: str, text: str, name: str
) -> DataFrame:
    """First place in name order with a distinctive token in the text: ``(key, place)``.

    Each token stands for one place only, the first by name, so a token in every text
    joins to one row per text and never to every place that has it.
    """
    token_place = (
        places.select(name, F.explode(F.split(F.lower(name), "[ /]")).alias("token"))
        .filter(distinctive_place_token(F.col("token")))
        .groupBy("token")
        .agg(F.min(name).alias("place"))
    )
    tokens = utterances.select(
        key, F.explode(F.array_distinct(letter_words(F.col(text)))).alias("token")
    )
    found = tokens.join(broadcast_if_small(token_place), "token")
    return found.groupBy(key).agg(F.min("place").alias("place"))


def name_phrases(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, phrase)``: the distinct telling phrases of 2 to 5 words per name."""
    split = df.select(key, words(F.col(text)).alias("tokens"))
    return split.select(key, F.explode(F.array_distinct(ngrams(F.col("tokens")))).alias("phrase"))


def spoken_phrases(df: DataFrame, key: str, text: str, heads: DataFrame) -> DataFrame:
    """``(key, phrase)``: runs of 2 to 5 words per text that start with one of the ``heads``.

    A head is a pair of words. Most pairs of a text start no known phrase, so a text costs
    one row per word and one look-up; longer runs are built for the few that remain.
    """
    tokens = df.select(key, words(F.col(text)).alias("t"))

    def following(n: int):
        return F.slice("t", F.lit(n), F.size("t"))

    pairs = F.zip_with("t", following(2), lambda a, b: F.concat(a, F.lit(" "), b))
    spans = F.arrays_zip(
        F.col("head"), following(3).alias("w3"), following(4).alias("w4"), following(5).alias("w5")
    )
    at = tokens.withColumn("head", pairs).select(key, F.explode(spans).alias("s"))
    at = at.select(key, "s.*").filter(F.col("head").isNotNull())
    started = at.join(broadcast_if_small(heads), "head", "left_semi")
    runs = [F.col("head")]
    for word in ("w3", "w4", "w5"):
        runs.append(F.concat(runs[-1], F.lit(" "), F.col(word)))
    phrases = started.select(key, F.explode(F.array(*runs)).alias("phrase"))
    return phrases.filter(F.col("phrase").isNotNull())


def match_listings(
    utterances: DataFrame,
    listings: DataFrame,
    key: str,
    text: str,
    listing_id: str,
    name: str,
) -> DataFrame:
    """Listing with the longest name phrase (2 to 5 words) in the text.

    Returns ``(key, listing_id, phrase_length)``; the lowest id wins a tie. Each phrase
    stands for its lowest listing id, so a common phrase joins to one row per text.
    """
    phrase_listing = (
        name_phrases(listings, listing_id, name)
        .groupBy("phrase")
        .agg(F.min(listing_id).alias("listing_id"))
    )
    heads = phrase_listing.select(F.substring_index("phrase", " ", 2).alias("head")).distinct()
    phrases = spoken_phrases(utterances, key, text, heads)
    found = phrases.join(broadcast_if_small(phrase_listing), "phrase")
    # (length desc, id asc) as one number keeps the aggregate in fixed-width buffers.
    length = F.length("phrase").cast("decimal(10,0)")
    order = length * F.lit("10000000000000000000").cast("decimal(20,0)") - F.col(
        "listing_id"
    ).cast("decimal(19,0)")
    return found.groupBy(key).agg(
        F.max_by("listing_id", order).alias("listing_id"),
        F.max(F.length("phrase")).alias("phrase_length"),
    )
