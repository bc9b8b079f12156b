"""Counts, distinct rows, de-duplication and means."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.catalog.ingest import listings, places
from lodgelens.catalog.joins import lines_as_reviews, parts_as_listings
from lodgelens.catalog.registry import load, query
from lodgelens.functions.values import range_to_null
from lodgelens.operators import evaluation, questions, ranking, sampling, views
from lodgelens.sources import tables


@query(
    "row_count",
    """
    SELECT 'bronze_listings' AS layer, count(*) AS n FROM customer
    UNION ALL SELECT 'silver_listings', count(*) FROM customer WHERE c_acctbal BETWEEN 10 AND 5000
    UNION ALL SELECT 'bronze_reviews', count(*) FROM (
        SELECT row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey) AS rn
        FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM (
            SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rk
            FROM part WHERE p_size > 0) WHERE rk <= 150)) WHERE rn <= 6
    UNION ALL SELECT 'gold_chunks', count(*) FROM documents WHERE length(text) > 0
    """,
)
def row_count(spark, folder):
    customer = load(spark, folder, "customer")
    priced = customer.withColumn("c_acctbal", range_to_null(F.col("c_acctbal")))
    sampled = sampling.stratified_reviews(
        parts_as_listings(spark, folder), lines_as_reviews(spark, folder)
    )
    return tables.row_counts(
        bronze_listings=customer,
        silver_listings=priced.dropna(subset=["c_acctbal", "c_mktsegment"]),
        bronze_reviews=sampled,
        gold_chunks=load(spark, folder, "documents").filter(F.length("text") > 0),
    )


@query("distinct_count", "SELECT count(DISTINCT l_partkey) AS listings FROM lineitem")
def distinct_count(spark, folder):
    return load(spark, folder, "lineitem").agg(F.countDistinct("l_partkey").alias("listings"))


@query("distinct_sorted", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY 1")
def distinct_sorted(spark, folder):
    return views.place_names(load(spark, folder, "part"), "p_brand")


@query(
    "distinct_rows",
    """
    SELECT DISTINCT c_custkey::VARCHAR AS id, c_name AS name, c_custkey / 1000.0::DOUBLE AS lat,
           c_custkey / 2000.0::DOUBLE AS lon, c_mktsegment AS room_type, c_acctbal AS price,
           n_name AS neighbourhood
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_custkey IN (SELECT o_custkey FROM orders)
    """,
)
def distinct_rows(spark, folder):
    reviewed = load(spark, folder, "orders").select(F.col("o_custkey").alias("listing_id"))
    enriched = views.enriched_listings(listings(spark, folder), places(spark, folder))
    return views.reviewed_listings(enriched, reviewed)


@query(
    "dedup_keep_first",
    "SELECT min(doc_id) AS doc_id, text, length(text) AS chars FROM documents GROUP BY text",
)
def dedup_keep_first(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "text")
    first = ranking.keep_first(docs, ["text"], [F.col("doc_id")])
    return first.withColumn("chars", F.length("text").cast("bigint"))


@query(
    "group_count_avg",
    "SELECT p_type, count(*) AS n, round(avg(p_retailprice), 2) AS avg_p_retailprice FROM part GROUP BY p_type",
)
def group_count_avg(spark, folder):
    return questions.average_by_group(load(spark, folder, "part"), "p_type", "p_retailprice")


@query(
    "mean_skip_missing",
    """
    SELECT round_even(avg(quality), 3) AS avg_quality, round_even(avg(toxic), 3) AS avg_toxic, count(*) AS n
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def mean_skip_missing(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id")
    judged = docs.join(load(spark, folder, "labels"), "doc_id", "left")
    return evaluation.mean_skip_missing(judged, "quality", "toxic")
