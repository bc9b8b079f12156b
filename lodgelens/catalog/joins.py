"""Join operators over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.catalog.ingest import ENRICHED, ENRICHED_SQL, listings, places
from lodgelens.catalog.registry import load, query
from lodgelens.functions.text import COMMON_NAME_WORDS, letter_words
from lodgelens.operators import chunks, matching, sampling, views
from lodgelens.session import spread_few_splits


def parts_as_listings(spark, folder):
    return load(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("neighbourhood"),
        F.col("p_size").alias("number_of_reviews"),
    )


def lines_as_reviews(spark, folder):
    return load(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("listing_id"),
        F.col("l_orderkey").alias("id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
    )


TARGET_SQL = """
    target AS (SELECT p_partkey FROM (
        SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rk
        FROM part WHERE p_size > 0) WHERE rk <= 10)
"""


@query(
    "join_sampled_reviews",
    f"""
    WITH {TARGET_SQL}
    SELECT l_partkey AS listing_id, l_orderkey AS id, strftime(l_shipdate, '%Y-%m-%d') AS date
    FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM target)
    """,
)
def join_sampled_reviews(spark, folder):
    target = sampling.busiest_listings(parts_as_listings(spark, folder), 10)
    return sampling.reviews_of(lines_as_reviews(spark, folder), target)


@query(
    "join_left_multikey",
    """
    SELECT l_partkey AS listing_id, l_orderkey AS id, l_linenumber, 'rome' AS city, p_brand AS neighbourhood,
           p_type AS room_type
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey
    """,
)
def join_left_multikey(spark, folder):
    reviews = load(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("listing_id"),
        F.col("l_orderkey").alias("id"),
        "l_linenumber",
        F.lit("rome").alias("city"),
    )
    kept = load(spark, folder, "part").filter("p_size > 25")
    known = kept.select(
        F.col("p_partkey").alias("id"),
        F.lit("rome").alias("city"),
        F.col("p_brand").alias("neighbourhood"),
        F.col("p_type").alias("room_type"),
    )
    return chunks.with_listing_columns(reviews, known)


@query("join_left_view", ENRICHED_SQL)
def join_left_view(spark, folder):
    return views.enriched_listings(listings(spark, folder), places(spark, folder)).select(*ENRICHED)


@query(
    "semi_join_distinct",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    """,
)
def semi_join_distinct(spark, folder):
    returned = load(spark, folder, "lineitem").filter("l_returnflag = 'R'")
    keys = returned.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return orders.join(keys, "o_orderkey", "left_semi")


def utterances(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return spread_few_splits(docs, "doc_id")


def word_places(spark, folder):
    """Places named after the longer words of each benchmark item, as ``First/Second``."""
    long_words = F.filter(letter_words(F.col("text")), lambda w: F.length(w) >= 4)
    return (
        load(spark, folder, "benchmark")
        .select(long_words.alias("w"))
        .filter(F.size("w") >= 2)
        .select(
            F.concat(F.initcap(F.col("w")[0]), F.lit("/"), F.initcap(F.col("w")[1])).alias("place_name")
        )
        .distinct()
    )


# DuckDB has no initcap: upper-case the first letter by hand.
WORD_PLACES_SQL = """
    long_words AS (SELECT list_filter(regexp_extract_all(lower(text), '[a-zàèéìòùáéíóú]+'),
                                      lambda w: length(w) >= 4) AS w FROM benchmark),
    places AS (SELECT DISTINCT upper(w[1][1]) || w[1][2:] || '/' || upper(w[2][1]) || w[2][2:] AS place_name
               FROM long_words WHERE len(w) >= 2),
    place_tokens AS (SELECT place_name, unnest(string_split(lower(place_name), '/')) AS token FROM places)
"""


def place_match_sql(table: str) -> str:
    return f"""
    {WORD_PLACES_SQL},
    text_tokens AS (SELECT DISTINCT doc_id,
                           unnest(regexp_extract_all(lower(text), '[a-zàèéìòùáéíóú]+')) AS token FROM {table}),
    place_match AS (SELECT doc_id, min(place_name) AS place FROM text_tokens JOIN place_tokens USING (token)
                    GROUP BY doc_id)
"""


@query("place_match_join", f"WITH {place_match_sql('documents')} SELECT doc_id, place FROM place_match")
def place_match_join(spark, folder):
    return matching.match_places(
        utterances(spark, folder), word_places(spark, folder), "doc_id", "text", "place_name"
    )


def _phrases_sql(table: str, key: str, out: str) -> str:
    """Phrases of 2 to 5 words by looking ahead from each word, common-only ones left out."""
    common = ", ".join(f"'{w}'" for w in sorted(set(COMMON_NAME_WORDS)))
    return f"""
    {out}_words AS (SELECT {key} AS id, w, pos FROM (
        SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9àèéìòùáéíóú&]+')) AS w,
               generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9àèéìòùáéíóú&]+'), 1) AS pos
        FROM {table})),
    {out}_ahead AS (SELECT id, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3,
                           lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
                    FROM {out}_words WINDOW o AS (PARTITION BY id ORDER BY pos)),
    {out}_grams AS (
        SELECT id, w1 || ' ' || w2 AS phrase, [w1, w2] AS ws FROM {out}_ahead WHERE w2 IS NOT NULL
        UNION ALL SELECT id, concat_ws(' ', w1, w2, w3), [w1, w2, w3] FROM {out}_ahead WHERE w3 IS NOT NULL
        UNION ALL SELECT id, concat_ws(' ', w1, w2, w3, w4), [w1, w2, w3, w4] FROM {out}_ahead
                  WHERE w4 IS NOT NULL
        UNION ALL SELECT id, concat_ws(' ', w1, w2, w3, w4, w5), [w1, w2, w3, w4, w5] FROM {out}_ahead
                  WHERE w5 IS NOT NULL),
    {out} AS (SELECT id, phrase FROM {out}_grams
              WHERE len(list_filter(ws, lambda x: x NOT IN ({common}))) > 0)
    """


def name_match_sql(table: str) -> str:
    return f"""
    {_phrases_sql("benchmark", "item_id", "names")},
    {_phrases_sql(table, "doc_id", "said")},
    name_match AS (SELECT doc_id, listing_id, phrase_length FROM (
        SELECT s.id AS doc_id, n.id AS listing_id, length(s.phrase) AS phrase_length,
               row_number() OVER (PARTITION BY s.id ORDER BY length(s.phrase) DESC, n.id) AS rn
        FROM (SELECT DISTINCT id, phrase FROM said) s
        JOIN (SELECT DISTINCT id, phrase FROM names) n USING (phrase)) WHERE rn = 1)
"""


@query(
    "name_match_join",
    f"WITH {name_match_sql('documents')} SELECT doc_id, listing_id, phrase_length FROM name_match",
)
def name_match_join(spark, folder):
    items = load(spark, folder, "benchmark")
    return matching.match_listings(
        utterances(spark, folder), items, "doc_id", "text", "item_id", "text"
    )
