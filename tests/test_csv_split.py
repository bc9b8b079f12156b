"""Multi-line exports split over tasks give the rows of the one-task reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from lodgelens.sources.csv_files import scan_csv
from lodgelens.sources.csv_split import scan_csv_split


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=end).writerows(rows)


@pytest.fixture
def small_blocks(spark):
    """Files are cut every 97 bytes."""
    for name, value in (("maxPartitionBytes", "97b"), ("openCostInBytes", "1b")):
        spark.conf.set(f"spark.sql.files.{name}", value)
    yield
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def same(spark, path, rows):
    got, want = scan_csv_split(spark, str(path)), scan_csv(spark, str(path))
    assert got.columns == want.columns
    assert rows(got) == rows(want)
    return got


PIECES = ["a", "è bello", ",", "\n", '"', "\n\n", '""', " ", "x,y", "\n\"", "parola " * 40, "riga\n" * 30, "", "'", "\t"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_random_fields(spark, tmp_path, rows, small_blocks, end):
    dice = random.Random(7)
    for name in ("a", "b", "c"):
        body = [[i, "".join(dice.choices(PIECES, k=dice.randrange(6))), dice.choice(["", "z", "\n"])] for i in range(120)]
        write(tmp_path / f"{name}.csv", [["id", "note", "last one"], *body], end)
    got = same(spark, tmp_path, rows)
    assert got.count() == 360


def test_field_over_many_blocks(spark, tmp_path, rows, small_blocks):
    long = "\n".join(f'line "{i}", of a long review' for i in range(200))
    write(tmp_path / "a.csv", [["id", "note"], [1, long], [2, "short"], [3, "w" * 5000], [4, long]])
    got = {r["id"]: r["note"] for r in same(spark, tmp_path, rows).collect()}
    assert got == {"1": long, "2": "short", "3": "w" * 5000, "4": long}


def test_blocks_are_read_by_many_tasks(spark, tmp_path, small_blocks):
    write(tmp_path / "a.csv", [["id", "note"], *[[i, f"one\ntwo {i}"] for i in range(400)]])
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = scan_csv_split(spark, str(tmp_path))
    assert got.filter(F.col("note") == F.concat(F.lit("one\ntwo "), "id")).count() == 400


def test_only_a_header_and_short_rows(spark, tmp_path, rows):
    write(tmp_path / "a.csv", [["id", "note"]])
    assert same(spark, tmp_path, rows).count() == 0
    (tmp_path / "b.csv").write_text('id,note\n1\n\n2,"x\ny",more\n3,no end')
    assert same(spark, tmp_path, rows).count() == 3


def test_compressed_files(spark, tmp_path, rows, small_blocks):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt", newline="", encoding="utf-8") as out:
        csv.writer(out).writerows([["id", "note"], *[[i, f"a\nb, {i}"] for i in range(50)]])
    assert same(spark, tmp_path, rows).count() == 50


def test_headers_must_agree(spark, tmp_path):
    write(tmp_path / "a.csv", [["x", "y"], [1, 2]])
    write(tmp_path / "b.csv", [["y", "x"], [3, 4]])
    with pytest.raises(Exception, match="(?i)header"):
        scan_csv_split(spark, str(tmp_path)).collect()
