"""Top-k, sampling, sorting and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.catalog.joins import TARGET_SQL, lines_as_reviews, parts_as_listings
from lodgelens.catalog.registry import load, query
from lodgelens.operators import ranking, sampling


@query(
    "topk_per_group",
    """
    SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey)
               AS rank FROM customer) WHERE rank <= 10
    """,
)
def topk_per_group(spark, folder):
    customer = load(spark, folder, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return ranking.top_per_key(
        customer, ["c_nationkey"], [F.desc("c_acctbal")], 10, tie="c_custkey"
    )


NEWEST_SQL = """
    SELECT listing_id, id, date FROM (
        SELECT l_partkey AS listing_id, l_orderkey AS id, strftime(l_shipdate, '%Y-%m-%d') AS date,
               row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey) AS rn
        FROM lineitem {where}) WHERE rn <= {n}
"""


@query("latest_n_per_key", NEWEST_SQL.format(where="", n=6))
def latest_n_per_key(spark, folder):
    return sampling.newest_reviews(lines_as_reviews(spark, folder))


@query(
    "stratified_sample",
    f"WITH {TARGET_SQL} "
    + NEWEST_SQL.format(where="WHERE l_partkey IN (SELECT p_partkey FROM target)", n=3),
)
def stratified_sample(spark, folder):
    return sampling.stratified_reviews(
        parts_as_listings(spark, folder), lines_as_reviews(spark, folder), 10, 3
    )


@query(
    "order_by",
    "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey",
)
def order_by(spark, folder):
    customer = load(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return customer.orderBy(F.desc("c_acctbal"), "c_custkey")


@query(
    "limit_n",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def limit_n(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
