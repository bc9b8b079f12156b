"""Best rows per key of a stream: any order of files, corrections, awkward values."""

import itertools
import random
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from lodgelens.operators import cleaning
from lodgelens.operators.ranking import keep_first
from lodgelens.streaming.best_rows import AFTER, BEFORE, CHANGE, INSERT, drain_best, first_of_batch, read_changes
from lodgelens.streaming.drain import file_stream
from lodgelens.streaming.live import drain_silver_reviews

KIND = "k long, place string, score double, at timestamp, id long, ok boolean"
KEYS, ORDER = ["k", "place"], ["score", "at", "ok", "id"]


def awkward(n, seed=1):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [
        (
            pick(1, 1, 1, 2, None), pick("a", "", None, "\u00e9"), pick(1.5, -2.0, float("nan"), float("inf"), None),
            pick(datetime(2024, 3, 31, 2, 30, 1, 7), datetime(1960, 1, 1), None), i, pick(True, False, None),
        )
        for i in range(n)
    ]


def files(spark, source, parts, kind=KIND):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{source}/{i:02d}")


def test_equals_the_batch_form_and_corrects(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = awkward(400)
    random.Random(2).shuffle(rows)
    files(spark, source, [rows[i::4] for i in range(4)] + [rows[:50]])
    table = spark.createDataFrame(rows, KIND)
    stream = file_stream(spark, source, table.schema, 1)
    want = sorted(map(repr, keep_first(table, KEYS, [F.col(c) for c in ORDER]).collect()))
    got = drain_best(stream, KEYS, ORDER, out, state)
    assert got.columns == table.columns and sorted(map(repr, got.collect())) == want
    # Nothing new: no batch. Repeats alone: no change.
    files_before = read_changes(spark, out, table.schema).count()
    spark.createDataFrame(rows, KIND).write.parquet(f"{source}/99")
    assert sorted(map(repr, drain_best(stream, KEYS, ORDER, out, state).collect())) == want
    changes = read_changes(spark, out, table.schema)
    assert changes.count() == files_before and changes.agg(F.max("batch")).first()[0] == 4 - (changes.filter("batch = 4").count() == 0)
    # Replaying the feed row by row gives the same table.
    held = {}
    for r in sorted(changes.collect(), key=lambda r: (r["batch"], r[CHANGE] == AFTER)):
        key, row = (r["k"], r["place"]), repr(tuple(r)[:6])
        if r[CHANGE] == INSERT:
            assert key not in held
        elif r[CHANGE] == BEFORE:
            assert held.pop(key) == row
            continue
        else:
            assert key not in held
        held[key] = row
    assert sorted(held.values()) == sorted(repr(tuple(r)) for r in got.collect())
    assert changes.filter(F.col(CHANGE) == BEFORE).count() > 0


def test_no_files_and_no_rows(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], KIND).schema
    assert drain_best(file_stream(spark, source, schema), KEYS, ORDER, out, state).count() == 0
    files(spark, source, [[]])
    assert drain_best(file_stream(spark, source, schema), KEYS, ORDER, out, state).count() == 0


def test_a_hot_key_sends_one_row_per_arrow_batch():
    rows = awkward(300, 5)
    names = ["k", "place", "score", "at", "id", "ok"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    kept = first_of_batch(batch, KEYS, ORDER)
    order = lambda r: [(0, 0) if v is None else (2, 0) if v != v else (1, v) for v in (r[2], r[3], r[5], r[4])]
    want = {}
    for r in rows:
        key = r[:2]
        if key not in want or order(r) < order(want[key]):
            want[key] = r
    assert sorted(kept["id"].to_pylist()) == sorted(r[4] for r in want.values())
    assert first_of_batch(batch.slice(0, 0), KEYS, ORDER).num_rows == 0


def test_silver_reviews_in_any_order_of_files(spark, tmp_path):
    kind = "listing_id long, id long, date string, reviewer_id long, comments string"
    text = "The flat was very nice and the bed is good"
    parts = [[(1, i, "2024-01-03", 7, text), (1, 10 + i, None, 7, text), (2, 20 - i, "2024-01-03", 7, text)] for i in (2, 1, 3)]
    want = sorted(map(repr, cleaning.silver_reviews(spark.createDataFrame(sum(parts, []), kind)).collect()))
    for n, turn in enumerate(list(itertools.permutations(parts))[:3]):
        source, out, state = (str(tmp_path / f"{x}{n}") for x in ("in", "out", "state"))
        files(spark, source, turn, kind)
        stream = file_stream(spark, source, spark.read.parquet(f"{source}/*").schema, 1)
        assert sorted(map(repr, drain_silver_reviews(stream, out, state).collect())) == want
