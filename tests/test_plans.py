"""Physical plans: what must be pushed down, limited early, or kept out of Python."""

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from lodgelens.catalog import QUERIES
from lodgelens.functions.language import with_language
from lodgelens.operators import cleaning, lexical, questions, ranking, request_log
from lodgelens.operators.embedding import embed_text

FOLDER = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_top_k_limits_before_the_shuffle(spark):
    plan = plan_of(QUERIES["topk_per_group"](spark, FOLDER))
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_dedup_limits_before_the_shuffle(spark):
    assert "Partial" in plan_of(QUERIES["dedup_keep_first"](spark, FOLDER))


def test_sampled_reviews_are_not_shuffled_before_the_filter(spark):
    plan = plan_of(QUERIES["stratified_sample"](spark, FOLDER))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_language_stays_in_the_jvm(spark):
    plan = plan_of(with_language(table(spark, "documents"), "text"))
    assert "Python" not in plan


@pytest.mark.parametrize("name", ["phase_stats", "repeat_requests", "name_match_join"])
def test_hash_aggregates_only(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_percentiles_read_only_the_buckets_they_need(spark):
    plan = plan_of(request_log.latency_percentiles(table(spark, "events"), "event_type", "value"))
    assert "LeftSemi" in plan and "partial_count" in plan
    assert "ReadSchema: struct<event_type:string,value:double>" in plan


def test_filters_and_columns_reach_the_scan(spark):
    part = table(spark, "part").filter(F.col("p_size") > 10)
    plan = plan_of(questions.average_by_group(part, "p_type", "p_retailprice"))
    assert "GreaterThan(p_size,10)" in plan
    assert "ReadSchema: struct<p_type:string,p_size:int,p_retailprice:double>" in plan


def test_shares_need_no_single_task_window(spark):
    plan = plan_of(QUERIES["distribution"](spark, FOLDER))
    assert "Window" not in plan and "Subquery" in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"knn_ann"}))
def test_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_word_statistics_count_before_the_shuffle(spark):
    docs = table(spark, "documents").select(F.split("text", " ").alias("words"))
    vocabulary = spark.createDataFrame([("the",)], "t string")
    plan = plan_of(lexical.word_statistics(docs, vocabulary))
    assert "partial_count" in plan and "BroadcastHashJoin" in plan


def test_salting_only_for_deep_lists(spark):
    events = table(spark, "events")
    shallow = ranking.top_per_key(events, ["event_type"], [F.desc("ts")], 100, tie="event_id")
    deep = ranking.top_per_key(events, ["event_type"], [F.desc("ts")], 101, tie="event_id")
    assert "_salt" not in plan_of(shallow) and "_salt" in plan_of(deep)


def test_costly_columns_are_not_copied_into_filters(spark):
    docs = table(spark, "documents")
    spoken = with_language(docs, "text").filter(F.col("lang").isin("en", "it"))
    assert plan_of(spoken.select("doc_id", "lang")).count("regexp_extract_all") == 1
    clean = cleaning.clean_comments(docs, "text").filter(F.col("text") != "x")
    assert plan_of(clean.select("doc_id", "text")).count("<[^>]+>") == 1


def test_vectors_are_computed_once(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    vectors = embed_text(docs, "text").filter(F.col("embedding").isNotNull())
    assert plan_of(vectors.select("doc_id", F.explode("embedding"))).count("ArrowEvalPython") == 1
