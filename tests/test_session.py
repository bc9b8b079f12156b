"""Scratch folders, shuffle sizes and size checks."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodgelens import bounds, session


def stub(master, root):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: root), sparkContext=SimpleNamespace(master=master)
    )


def test_scratch_is_where_the_cluster_says():
    path = session.scratch_path(stub("yarn", "hdfs://shared/tmp/"), "x")
    assert path.startswith("hdfs://shared/tmp/lodgelens/x-")
    assert path != session.scratch_path(stub("yarn", "hdfs://shared/tmp/"), "x")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch_path(stub("yarn", None), "x")
    assert "lodgelens-" in session.scratch_path(stub("local[2]", None), "x")


def test_materialise_keeps_schema_and_rows(spark):
    df = spark.range(10).select("id", F.lit(None).cast("string").alias("s"))
    stored = session.materialise(df, "test")
    assert stored.count() == 10 and stored.dtypes == df.dtypes


def test_shuffle_sizes(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.size_shuffles(spark, 0) == 2 * spark.sparkContext.defaultParallelism
        assert session.size_shuffles(spark, 100 * 10**12) == -(-100 * 10**12 // (256 * 1024 * 1024))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    (tmp_path / "a.csv").write_text("12345")
    (tmp_path / "b.csv").write_text("123")
    assert session.stored_bytes(spark, str(tmp_path)) == 8
    assert session.stored_bytes(spark, str(tmp_path / "*.csv")) == 8
    assert session.stored_bytes(spark, str(tmp_path / "none")) == 0


def test_only_few_splits_are_spread(spark):
    one = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert session.spread_few_splits(one, "doc_id").rdd.getNumPartitions() == 8
    many = spark.range(0, 1000, 1, 32)
    assert session.spread_few_splits(many, "id") is many


def test_measured_bytes_grow_with_values(spark):
    short = spark.createDataFrame([("a", [1.0]), (None, None)], "s string, v array<double>")
    long = spark.createDataFrame([("a" * 1000, [1.0] * 500), (None, None)], "s string, v array<double>")
    assert bounds.measured_bytes(long) - bounds.measured_bytes(short) == 999 + 499 * 8
    assert bounds.measured_bytes(short.filter("false")) == 0
    assert bounds.fits_broadcast(long) and not bounds.fits_broadcast(long, 100)
