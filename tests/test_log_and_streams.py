"""Request-log metrics on awkward logs, streams against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from lodgelens.catalog.streams import document_chunks
from lodgelens.operators import chunks as chunk_ops
from lodgelens.operators import cleaning
from lodgelens.operators import request_log as log_ops
from lodgelens.streaming.drain import file_stream
from lodgelens.streaming.index_sync import compact_index, read_index, sync_index
from lodgelens.streaming.live import drain_counters, drain_silver_reviews, drain_unique, running_counters

LOG = "event_id long, ts timestamp, q string, ok boolean, phase string, ms double"


def at(second):
    return f"2024-01-01 00:00:{second:02d}"


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (1, at(1), "a", False, "generate", 1.25),
        (2, at(2), "a", True, "generate", 2.25),
        (3, at(2), "a", True, "generate", 3.0),
        (4, at(4), "b", True, "rerank", 7.77),
        (5, at(5), None, True, "generate", 4.0),
        (6, at(6), None, False, "generate", 5.0),
    ]
    text = spark.createDataFrame(rows, LOG.replace("timestamp", "string"))
    return text.withColumn("ts", F.col("ts").cast("timestamp"))


def test_repeats_count_from_the_first_success(log):
    marked = log_ops.repeat_requests(log, ["q"], "ts", "event_id", F.col("ok"))
    got = {r["event_id"]: r["hit"] for r in marked.collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True}
    ratio = log_ops.cache_ratio(marked).first()
    assert tuple(ratio) == (2, 4, 0.333)
    assert tuple(log_ops.cache_ratio(marked.filter("false")).first()) == (0, 0, 0.0)


def test_phase_stats_round_half_even(log):
    got = {r["phase"]: tuple(r)[1:] for r in log_ops.phase_stats(log, "phase", "ms", "ts", "event_id").collect()}
    assert got == {"generate": (5, 3.1, 5.0), "rerank": (1, 7.8, 7.8)}


def nearest_rank(values, p):
    ordered = sorted(values)
    return ordered[int(round(p / 100 * (len(ordered) - 1)))]


def test_percentiles_with_one_hot_value(spark):
    rnd = random.Random(3)
    values = [("a", 5.0)] * 400 + [("a", rnd.randrange(1, 9000) / 10) for _ in range(700)] + [("b", 2.5)]
    values += [(None, -3.5), (None, 0.0), (None, 7200000.0), (None, -0.2), ("b", None)]
    df = spark.createDataFrame(values, "phase string, ms double")
    got = {r["phase"]: r for r in log_ops.latency_percentiles(df, "phase", "ms").collect()}
    only = [v for k, v in values if k == "a"]
    for p in (50, 95, 99):
        assert got["a"][f"p{p}"] == nearest_rank(only, p)
        assert got["b"][f"p{p}"] == 2.5
    assert got["a"]["n"] == 1100 and got["a"]["max"] == max(only)
    assert tuple(got[None])[1:] == (4, 0.0, 7200000.0, 7200000.0, 1799999.1, 7200000.0)
    near = log_ops.latency_percentiles_approx(df, "phase", "ms").filter("phase = 'a'").first()
    assert abs(near["p95"] - got["a"]["p95"]) < 5


def test_keep_last(log):
    kept = log_ops.keep_last(log, "phase", "ts", "event_id", 2).collect()
    assert sorted((r["phase"], r["age"], r["event_id"]) for r in kept) == [
        ("generate", 1, 6),
        ("generate", 2, 5),
        ("rerank", 1, 4),
    ]


def test_kpis(log):
    marked = log_ops.repeat_requests(log, ["q"], "ts", "event_id", F.col("ok"))
    got = log_ops.kpi_totals(marked, "ms", F.col("phase") == "rerank", ~F.col("ok")).first()
    assert tuple(got) == (6, 33, 7.8, 2)


def test_counters_continue_over_runs(spark, log, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    log.filter("event_id <= 3").write.parquet(f"{source}/1")

    def run():
        stream = file_stream(spark, source, log.schema)
        return drain_counters(
            running_counters(stream, "phase", "ms", "ts", "event_id", ~F.col("ok")), out, state
        )

    assert {r["phase"]: r["n"] for r in run().collect()} == {"generate": 3}
    log.filter("event_id > 3").write.parquet(f"{source}/2")
    got = {r["phase"]: (r["n"], r["errors"], r["last_ms"]) for r in run().collect()}
    assert got == {"generate": (5, 2, 5.0), "rerank": (1, 0, 7.8)}


def test_dedup_across_files(spark, log, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for drop in range(2):
        log.write.parquet(f"{source}/{drop}")
    stream = file_stream(spark, source, log.schema, 1)
    got = drain_unique(stream, ["event_id"], ["ts"], out, state)
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3, 4, 5, 6]
    assert drain_unique(stream, ["event_id"], ["ts"], out, state).count() == 6


def test_late_reviews_stay(spark, tmp_path):
    kind = "listing_id long, id long, date string, reviewer_id long, comments string"
    text = "The flat was very nice and the bed is good"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i, year in enumerate((2024, 2023, 2022, 2024)):
        rows = [(1, 10 + i, f"{year}-01-03", 7, text), (1, 20 + i, None, 7, text)]
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{source}/{i}")
    bronze = spark.read.parquet(f"{source}/*")
    got = drain_silver_reviews(file_stream(spark, source, bronze.schema, 1), out, state)
    want = cleaning.silver_reviews(bronze)
    keys = ["listing_id", "reviewer_id", "date"]
    assert sorted(map(repr, got.select(keys).collect())) == sorted(map(repr, want.select(keys).collect()))


def test_silver_reviews_as_a_stream(spark, tmp_path):
    kind = "listing_id long, id long, date string, reviewer_id long, comments string"
    first = [
        (1, 10, "2024-01-03", 7, "The flat was<br/>very nice and the bed is good"),
        (1, 11, "2024-01-03", 7, "the same guest and the same date, a later row"),
        (1, 12, "2024-01-02", 8, "die Wohnung ist sehr schön und nicht laut"),
        (2, 13, "2024-01-02", 8, " "),
    ]
    second = [(1, 10, "2024-01-03", 7, first[0][4]), (2, 14, "2024-01-04", 8, "la casa è molto bella e pulita")]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i, part in enumerate((first, second)):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{source}/{i}")
    bronze = spark.read.parquet(f"{source}/*")
    keys = ["listing_id", "reviewer_id", "date", "lang"]
    silver = drain_silver_reviews(file_stream(spark, source, bronze.schema, 1), out, state)
    got = silver.select(keys).collect()
    want = cleaning.silver_reviews(bronze).select(keys).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2


def test_sync_runs_only_what_is_new(spark, tmp_path):
    docs = document_chunks(spark, "/root/testdata/sf0.001")
    gold, index = (str(tmp_path / n) for n in ("gold", "index"))
    changes = chunk_ops.publish_version(docs.filter("listing_id < 100"), gold, 1)
    assert sync_index(spark, f"{gold}/changes", changes.schema, index).count() == 100
    edited = docs.withColumn(
        "chunk_text", F.when(F.col("listing_id") == 5, "now new").otherwise(F.col("chunk_text"))
    ).filter("listing_id <> 7")
    second = chunk_ops.publish_version(edited, gold, 2, previous=1)
    assert second.filter("_change_type = 'update'").count() == 1
    rows = sync_index(spark, f"{gold}/changes", changes.schema, index)
    kept = {r["chunk_id"]: r["chunk_text"] for r in rows.collect()}
    assert len(kept) == docs.count() - 1 and "7" not in kept and kept["5"] == "now new"
    assert sync_index(spark, f"{gold}/changes", changes.schema, index).count() == len(kept)
    columns = [c for c in rows.columns if c != "embedding"]
    before = rows.select(columns)
    compact = compact_index(spark, index).select(columns)
    assert compact.exceptAll(before).count() == 0 and compact.count() == len(kept)
    chunk_ops.publish_version(edited.filter("listing_id <> 9"), gold, 3, previous=2)
    after = sync_index(spark, f"{gold}/changes", changes.schema, index)
    assert before.select("chunk_id").exceptAll(after.select("chunk_id")).collect() == [("9",)]
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "BroadcastHashJoin" in plan


def test_no_index_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="no index"):
        read_index(spark, str(tmp_path / "nothing"))
