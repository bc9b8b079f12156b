"""The analytic question shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.catalog.registry import load, query
from lodgelens.operators import questions as ask
from lodgelens.plans.analytics import preview_audited


def _located(spark, folder):
    customer, nation = load(spark, folder, "customer"), load(spark, folder, "nation")
    region = load(spark, folder, "region")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )


@query(
    "avg_by_group",
    "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 2) AS avg_c_acctbal FROM customer"
    " GROUP BY c_mktsegment",
)
def avg_by_group(spark, folder):
    return ask.average_by_group(load(spark, folder, "customer"), "c_mktsegment", "c_acctbal")


@query(
    "avg_filtered",
    "SELECT round(avg(p_retailprice), 2) AS avg_p_retailprice FROM part WHERE p_brand ILIKE '%brand#1%'",
)
def avg_filtered(spark, folder):
    return ask.average_where(load(spark, folder, "part"), "p_brand", "brand#1", "p_retailprice")


@query(
    "count_filtered",
    "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey"
    r" WHERE n_name ILIKE '%nation\_7%' ESCAPE '\'",
)
def count_filtered(spark, folder):
    return ask.count_where(_located(spark, folder), "n_name", "nation_7")


@query(
    "top_groups",
    "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5",
)
def top_groups(spark, folder):
    return ask.top_groups(load(spark, folder, "part"), "p_brand")


@query(
    "min_max_filtered",
    "SELECT max(p_retailprice) AS max_p_retailprice, min(p_retailprice) AS min_p_retailprice FROM part"
    " WHERE p_brand ILIKE '%brand#2%'",
)
def min_max_filtered(spark, folder):
    return ask.extremes_where(load(spark, folder, "part"), "p_brand", "BRAND#2", "p_retailprice")


@query(
    "count_groups_having",
    "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 10)",
)
def count_groups_having(spark, folder):
    return ask.groups_over(load(spark, folder, "orders"), "o_custkey", 10)


@query(
    "lookup_by_name",
    "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_name ILIKE '%red widget%'",
)
def lookup_by_name(spark, folder):
    part = load(spark, folder, "part")
    return ask.lookup(part, "p_name", "Red Widget", "p_partkey", "p_name", "p_retailprice")


@query(
    "locate_by_name",
    """
    SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE c_name ILIKE '%#0000001%'
    """,
)
def locate_by_name(spark, folder):
    return ask.lookup(_located(spark, folder), "c_name", "#0000001", "c_name", "n_name", "r_name")


@query(
    "extreme_rows",
    """
    SELECT * FROM (SELECT 'cheapest' AS which, p_partkey, p_retailprice FROM part
                   ORDER BY p_retailprice, p_partkey LIMIT 3)
    UNION ALL
    SELECT * FROM (SELECT 'dearest', p_partkey, p_retailprice FROM part
                   ORDER BY p_retailprice DESC, p_partkey LIMIT 3)
    """,
)
def extreme_rows(spark, folder):
    part = load(spark, folder, "part").select("p_partkey", "p_retailprice")
    cheap = ask.extreme_rows(part, "p_retailprice", "p_partkey", 3)
    dear = ask.extreme_rows(part, "p_retailprice", "p_partkey", 3, highest=True)
    return cheap.select(F.lit("cheapest").alias("which"), "*").unionByName(
        dear.select(F.lit("dearest").alias("which"), "*")
    )


@query(
    "distribution",
    """
    SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share
    FROM orders GROUP BY o_orderpriority
    """,
)
def distribution(spark, folder):
    return ask.distribution(load(spark, folder, "orders"), "o_orderpriority")


@query(
    "result_preview",
    """
    SELECT 'o_orderkey | o_orderstatus' || chr(10) || '--- | ---' || chr(10)
           || string_agg(o_orderkey || ' | ' || o_orderstatus, chr(10) ORDER BY o_orderkey DESC) AS preview,
           (SELECT count(*) FROM orders) AS row_count
    FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 20)
    """,
)
def result_preview(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return ask.result_preview(orders, [F.desc("o_orderkey")])


@query(
    "audited_preview",
    """
    SELECT 'o_orderpriority | n' || chr(10) || '--- | ---' || chr(10)
           || string_agg(o_orderpriority || ' | ' || n, chr(10) ORDER BY n DESC, o_orderpriority) AS preview,
           count(*) AS row_count
    FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderpriority)
    """,
)
def audited_preview(spark, folder):
    """A model's statement over the orders: audited, run and shown."""
    statement = "```sql\nSELECT o_orderpriority, count(*) AS n FROM order_listings WHERE o_orderstatus <> 'F' GROUP BY 1;\n```"
    order = [F.desc("n"), F.asc("o_orderpriority")]
    return preview_audited(spark, statement, order, order_listings=load(spark, folder, "orders"))
