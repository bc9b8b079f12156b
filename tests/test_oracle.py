"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest
from conftest import plan_of

from lodgelens import bounds
from lodgelens.catalog import ORACLES, QUERIES
from lodgelens.operators import rerank, topk

FOLDER = "/root/testdata/sf0.001"

# Checked for rows here and for recall in test_search.py.
WITHOUT_SQL = {"knn_ann"}


@pytest.fixture(scope="module")
def duck():
    con = compare.connect(FOLDER)
    yield con
    con.close()


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    assert compare.difference(spark, duck, name, FOLDER) is None


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert QUERIES.keys() <= contract.queries().keys()
    assert ORACLES.keys() <= contract.oracle_sql().keys() <= contract.queries().keys()


# Queries whose operators broadcast something when it is small.
BROADCASTING = [
    "join_sampled_reviews", "stratified_sample", "row_count", "place_match_join", "name_match_join",
    "scope_resolve", "snapshot_diff", "gold_sink_cdf", "latency_percentiles", "repeat_requests",
    "enriched_view", "distinct_rows", "knn_exact", "knn_filtered", "knn_ann", "lexical_topk",
    "hybrid_fuse", "pair_join", "rerank_topk", "retrieve_then_rerank", "ir_metrics",
    "triggered_sync",
]


@pytest.mark.parametrize("name", BROADCASTING)
def test_query_agrees_without_any_broadcast(spark, duck, monkeypatch, name):
    """The plans taken when nothing is small enough give the same rows."""
    monkeypatch.setattr(bounds, "MAX_BROADCAST_BYTES", -1)
    monkeypatch.setattr(topk, "BROADCAST_QUERY_BYTES", -1)
    monkeypatch.setattr(rerank, "SMALL_HITS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, FOLDER)
        assert "BroadcastHashJoin" not in plan_of(df)
        assert compare.difference(spark, duck, name, FOLDER) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
