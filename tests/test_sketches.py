"""Stored sketches: any split merges to the same counts and to estimates inside the bounds."""

import random

from pyspark.sql import functions as F

from lodgelens.operators import sketches
from lodgelens.streaming.drain import file_stream
from lodgelens.streaming.live import drain_sketches

KIND = "phase string, ms double, ts string, user string"


def log_rows(n):
    rng = random.Random(8)
    rows = [("a", 5.0, f"2024-01-0{rng.randrange(1, 4)} 0{rng.randrange(9)}:10:00", "hot") for _ in range(n // 3)]
    rows += [("a", rng.expovariate(0.01), f"2024-01-0{rng.randrange(1, 4)} 01:00:00", f"u{rng.randrange(3000)}") for _ in range(n)]
    return rows + [(None, None, None, None), ("b", float("nan"), "2024-01-01 00:00:00", "x"), ("b", None, None, "x")]


def check(rows, got):
    values = sorted(r[1] for r in rows if r[0] == "a")
    for p in (50, 95, 99):
        q = got["a"][f"p{p}"]
        low = sum(v < q for v in values) / len(values)
        high = sum(v <= q for v in values) / len(values)
        assert low <= p / 100 + sketches.RANK_BOUND and high >= p / 100 - sketches.RANK_BOUND
    users = len({r[3] for r in rows if r[0] == "a"})
    assert abs(got["a"]["identities"] - users) <= sketches.COUNT_BOUND * users
    assert (got["a"]["n"], got["a"]["n_timed"]) == (len(values), len(values))


def test_sketches_merge_over_runs(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = log_rows(6000)
    schema = spark.createDataFrame([], KIND).withColumn("ts", F.col("ts").cast("timestamp")).schema
    (tmp_path / "in").mkdir()

    def run():
        stream = file_stream(spark, source, schema, 1)
        return drain_sketches(stream, "phase", "ms", "ts", "user", out, state)

    assert sketches.report(run()).count() == 0
    for i in range(3):
        part = spark.createDataFrame(rows[i::3], KIND).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.parquet(f"{source}/{i}")
        stored = run()
    got = {r["phase"]: r for r in sketches.report(stored).collect()}
    check(rows, got)
    assert tuple(got["b"])[1:] == (2, 0, None, None, None, 1) and tuple(got[None])[1:] == (1, 0, None, None, None, 0)
    day = [r for r in rows if (r[2] or "").startswith("2024-01-02")]
    some = sketches.in_hours(stored, "2024-01-02 00:00:00", "2024-01-03 00:00:00")
    check(day, {r["phase"]: r for r in sketches.report(some).collect()})
