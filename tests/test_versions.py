"""Stored versions: digests, changes by range and as a stream."""

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from lodgelens.operators import chunks
from lodgelens.operators.versions import VersionedTable
from lodgelens.streaming.drain import drain_to_parquet

KIND = "chunk_id string, t string, n int"


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], KIND).schema
    return VersionedTable(spark, str(tmp_path / "table"), schema, buckets=16)


def numbered(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("t"), F.col("id").cast("int").alias("n"))


def test_equal_versions_read_nothing(spark, table):
    rows = numbered(spark, 500)
    assert table.publish(rows, 1).count() == 500
    # Another order and another spread of the same rows.
    assert table.publish(rows.repartition(7).orderBy(F.desc("n")), 2, previous=1).count() == 0
    assert table.differing(1, 2) == []
    assert table.read(2).exceptAll(rows).count() == 0 and table.read(2).count() == 500


def test_only_differing_buckets_are_read(spark, table, rows):
    base = numbered(spark, 500)
    table.publish(base, 1)
    edited = base.withColumn("t", F.when(F.col("n") == 7, F.lit(None)).otherwise(F.col("t"))).filter("n <> 9")
    got = table.publish(edited.unionByName(spark.createDataFrame([("new", "", None)], KIND)), 2, previous=1)
    assert rows(got, "chunk_id", "_change_type") == [("7", "update"), ("9", "delete"), ("new", "insert")]
    touched = table.differing(1, 2)
    assert 1 <= len(touched) <= 3
    read = table._stored(1).filter(F.col("_bucket").isin(touched))
    assert "PartitionFilters: [_bucket" in read._jdf.queryExecution().toString().replace("isnotnull(", "")
    assert read.count() == base.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(16)).isin(touched)).count() < 500
    # Any two versions: back from 2 to 1.
    assert rows(table.diff(2, 1), "chunk_id", "_change_type") == [("7", "update"), ("9", "insert"), ("new", "delete")]


def test_same_as_the_whole_comparison(spark, table, rows):
    old = numbered(spark, 300).filter("n % 7 <> 1")
    new = numbered(spark, 300).filter("n % 11 <> 2").withColumn("t", F.when(F.col("n") % 13 == 0, "x").otherwise(F.col("t")))
    table.publish(old, 1)
    got = table.publish(new, 2, previous=1)
    columns = ["chunk_id", "t", "n", "_change_type"]
    assert rows(got, *columns) == rows(chunks.snapshot_diff(old, new), *columns)


def test_empty_versions_and_other_columns(spark, table, rows):
    nothing = spark.createDataFrame([], KIND)
    assert table.publish(nothing, 1).count() == 0
    some = numbered(spark, 3).withColumn("extra", F.lit(1)).select("extra", "n", "t", "chunk_id")
    assert rows(table.publish(some, 2, previous=1), "chunk_id", "_change_type") == [(k, "insert") for k in "012"]
    assert rows(table.publish(nothing, 3, previous=2), "chunk_id", "_change_type") == [(k, "delete") for k in "012"]
    assert table.read(3).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        table.publish(some.drop("t"), 4, previous=3)


def test_ranges_read_their_own_folders(spark, table):
    for v in range(1, 5):
        table.publish(numbered(spark, 10 * v), v, previous=v - 1 or None)
    part = table.changes(2, 3)
    assert part.count() == 20 and part.filter("n >= 10 AND n < 30").count() == 20
    assert len(part.inputFiles()) < len(table.changes(1, 4).inputFiles()) or "PartitionFilters" in plan_of(part)


def test_stream_gives_each_change_once(spark, table, tmp_path, rows):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    table.publish(numbered(spark, 5), 1)
    table.publish(numbered(spark, 6), 2, previous=1)
    stream = table.change_stream(2, files_per_batch=1)
    drain_to_parquet(stream, out, state)
    drain_to_parquet(table.change_stream(2, files_per_batch=1), out, state)
    table.publish(numbered(spark, 4), 3, previous=2)
    drain_to_parquet(table.change_stream(2, files_per_batch=1), out, state)
    got = spark.read.schema(stream.schema).parquet(out)
    assert rows(got, "_version", "chunk_id", "_change_type") == [(2, "5", "insert"), (3, "4", "delete"), (3, "5", "delete")]
