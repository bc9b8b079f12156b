"""Counters, ratios and latencies out of an append-only request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.functions.values import event_order
from lodgelens.operators.ranking import top_per_key
from lodgelens.session import materialise

# Fixed value: timings kept per phase when the state is saved.
KEPT_TIMINGS = 200


def intent_counts(log: DataFrame, intent: str) -> DataFrame:
    return log.groupBy(F.col(intent).alias("intent")).agg(F.count("*").alias("n"))


def error_counts(log: DataFrame, where: str, is_error: Column) -> DataFrame:
    failed = log.filter(is_error)
    return failed.groupBy(F.col(where).alias("place")).agg(F.count("*").alias("n"))


def repeat_requests(
    log: DataFrame, keys: list[str], ts: str, event_id: str, succeeded: Column
) -> DataFrame:
    """Mark requests whose key had already succeeded earlier (``hit``).

    A failed request leaves nothing to reuse. Each key's first success is a minimum, so
    a key with a third of all requests is reduced before the shuffle; a running window
    would walk it in one task instead.
    """
    order = event_order(F.col(ts), F.col(event_id))
    first = (
        log.filter(succeeded)
        .groupBy(*[F.col(k).alias(f"_{k}") for k in keys])
        .agg(F.min(order).alias("_first_success"))
    )
    on = [log[k].eqNullSafe(first[f"_{k}"]) for k in keys]
    joined = log.join(first, on, "left")
    hit = F.coalesce(order > F.col("_first_success"), F.lit(False))
    return joined.select(*log.columns, hit.alias("hit"))


def cache_ratio(marked: DataFrame, hit: str = "hit") -> DataFrame:
    """Hits, misses and their ratio to three places, 0 without requests."""
    hits, total = F.count_if(F.col(hit)), F.count("*")
    return marked.agg(
        hits.alias("hits"),
        (total - hits).alias("misses"),
        F.bround(F.coalesce(F.try_divide(hits, total), F.lit(0.0)), 3).alias("hit_ratio"),
    )


def phase_stats(log: DataFrame, phase: str, ms: str, ts: str, event_id: str) -> DataFrame:
    """Per phase: number, mean and last timing, to one place."""
    order = event_order(F.col(ts), F.col(event_id))
    return log.groupBy(F.col(phase).alias("phase")).agg(
        F.count("*").alias("n"),
        F.bround(F.avg(ms), 1).alias("avg_ms"),
        F.bround(F.max_by(ms, order), 1).alias("last_ms"),
    )


def _coarse_bucket(ms: Column) -> Column:
    """Bucket of about one percent width that never orders two timings the wrong way."""
    step = F.floor(F.log2(F.abs(ms) + 1) * 64)
    # Never null, so the join on it adds no null test that would work it out again.
    return F.coalesce(F.when(ms < 0, -step).otherwise(step), F.lit(0).cast("bigint"))


def latency_percentiles(
    log: DataFrame, phase: str, ms: str, points: tuple[int, ...] = (50, 95, 99)
) -> DataFrame:
    """Exact nearest-rank percentiles, mean and maximum per phase, to one place.

    Rounding keeps order, so the percentile of rounded timings is the rounded percentile.
    A first pass counts some two thousand buckets per phase, which tells in which bucket a
    percentile lies. A second pass counts the distinct timings of those buckets alone. So
    both shuffles carry counts, no matter how long the log or how full one phase is.
    """
    timed = log.filter(F.col(ms).isNotNull()).select(
        F.col(phase).alias("phase"), F.col(ms).alias("raw"), F.bround(ms, 1).alias("ms")
    )
    timed = timed.withColumn("bucket", _coarse_bucket(F.col("ms")))
    buckets = materialise(
        timed.groupBy("phase", "bucket").agg(
            F.count("*").alias("n"), F.sum("raw").alias("sum_ms"), F.max("ms").alias("top")
        ),
        "latency-buckets",
    )
    running = Window.partitionBy("phase").orderBy("bucket")
    whole = Window.partitionBy("phase")
    ranked = buckets.withColumns(
        {"upto": F.sum("n").over(running), "last": F.sum("n").over(whole) - 1}
    )
    index = {p: F.bround(F.lit(p / 100) * F.col("last"), 0).cast("bigint") for p in points}
    targets = F.array(
        *[
            F.struct(F.lit(p).alias("p"), F.least("last", i).alias("index"))
            for p, i in index.items()
        ]
    )
    below = F.col("upto") - F.col("n")
    wanted = ranked.select(
        F.col("phase").alias("in_phase"), "bucket", "upto", "n", F.explode(targets).alias("t")
    ).select("in_phase", "bucket", "t.p", (F.col("t.index") - below).alias("at"), "n")
    # Stored, so that Spark sees its size: a few rows per phase, broadcast while small.
    wanted = materialise(wanted.filter("at >= 0 and at < n").drop("n"), "latency-targets")
    spots = wanted.select("in_phase", "bucket").distinct()

    def same(left: DataFrame, right: DataFrame) -> list[Column]:
        return [left["phase"].eqNullSafe(right["in_phase"]), left["bucket"] == right["bucket"]]

    near = timed.join(spots, same(timed, spots), "left_semi")
    values = near.groupBy("phase", "bucket", "ms").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("phase", "bucket").orderBy("ms")
    values = values.withColumn("upto", F.sum("n").over(inside))
    hit = (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))
    picked = values.join(wanted, same(values, wanted)).filter(hit)
    picks = picked.groupBy(F.col("phase").alias("in_phase")).agg(
        *[F.max(F.when(F.col("p") == p, F.col("ms"))).alias(f"p{p}") for p in points]
    )
    totals = buckets.groupBy("phase").agg(
        F.sum("n").alias("n"),
        F.bround(F.sum("sum_ms") / F.sum("n"), 1).alias("mean"),
        F.max("top").alias("max"),
    )
    joined = totals.join(picks, totals["phase"].eqNullSafe(picks["in_phase"]))
    return joined.select("phase", "n", *[f"p{p}" for p in points], "mean", "max")


def latency_percentiles_approx(
    log: DataFrame, phase: str, ms: str, points: tuple[int, ...] = (50, 95, 99), accuracy: int = 10_000
) -> DataFrame:
    """Sketch form of the percentiles, in one pass."""
    picks = [F.percentile_approx(ms, p / 100, accuracy).alias(f"p{p}") for p in points]
    return log.groupBy(F.col(phase).alias("phase")).agg(F.count("*").alias("n"), *picks)


def keep_last(
    log: DataFrame, phase: str, ts: str, event_id: str, n: int = KEPT_TIMINGS
) -> DataFrame:
    """The last ``n`` rows per phase, numbered backwards by ``age`` from 1."""
    order = [F.desc(ts), F.desc(event_id)]
    return top_per_key(log, [phase], order, n, tie=event_id, rank="age")


def kpi_totals(
    marked: DataFrame, ms: str, is_generation: Column, is_error: Column, hit: str = "hit"
) -> DataFrame:
    """Requests, hit percentage, mean generation time and errors, in one pass."""
    ratio = F.bround(F.coalesce(F.try_divide(F.count_if(F.col(hit)), F.count("*")), F.lit(0.0)), 3)
    return marked.agg(
        F.count("*").alias("requests"),
        F.round(ratio * 100, 0).cast("int").alias("hit_percent"),
        F.bround(F.coalesce(F.avg(F.when(is_generation, F.col(ms))), F.lit(0.0)), 1).alias(
            "generation_ms"
        ),
        F.count_if(is_error).alias("errors"),
    )


def metric_state(
    marked: DataFrame, intent: str, ms: str, ts: str, event_id: str, is_error: Column, hit: str = "hit"
) -> DataFrame:
    """The counters and the kept timings as rows ``(kind, name, seq, value)``."""
    counted = marked.select(
        F.explode(
            F.array(
                F.struct(F.lit("intent").alias("kind"), F.col(intent).alias("name")),
                F.struct(
                    F.lit("cache").alias("kind"),
                    F.when(F.col(hit), "hit").otherwise("miss").alias("name"),
                ),
                F.struct(
                    F.when(is_error, "error").alias("kind"),
                    F.when(is_error, F.col(intent)).alias("name"),
                ),
            )
        ).alias("c")
    ).filter(F.col("c.kind").isNotNull())
    counters = counted.groupBy("c.kind", "c.name").agg(F.count("*").cast("double").alias("value"))
    counters = counters.select("kind", "name", F.lit(1).cast("bigint").alias("seq"), "value")
    kept = keep_last(marked.select(intent, ms, ts, event_id), intent, ts, event_id)
    timings = kept.select(
        F.lit("phase").alias("kind"),
        F.col(intent).alias("name"),
        F.col("age").cast("bigint").alias("seq"),
        F.col(ms).alias("value"),
    )
    return counters.unionByName(timings)


def metrics_snapshot(state: DataFrame) -> DataFrame:
    """The saved metric state as one table ``(section, name, n, value, last)``.

    Sections: ``intent`` and ``error`` with their counts; ``cache`` with hits, misses and the row
    ``ratio`` (three places, 0 without requests); ``phase`` with the number of kept timings, their
    mean (``value``) and the newest one (``last``), to one place. One aggregate over the state,
    and one over its two cache rows.
    """
    timing = F.col("kind") == "phase"
    rows = state.groupBy(F.col("kind").alias("section"), "name").agg(
        F.when(F.first(timing), F.count("value")).otherwise(F.sum("value").cast("bigint")).alias("n"),
        F.when(F.first(timing), F.bround(F.avg("value"), 1)).alias("value"),
        F.when(F.first(timing), F.bround(F.min_by("value", "seq"), 1)).alias("last"),
    )
    hits = F.coalesce(F.sum(F.when(F.col("name") == "hit", F.col("value"))), F.lit(0.0))
    total = F.coalesce(F.sum("value"), F.lit(0.0))
    ratio = state.filter(F.col("kind") == "cache").agg(
        total.cast("bigint").alias("n"),
        F.bround(F.coalesce(F.try_divide(hits, total), F.lit(0.0)), 3).alias("value"),
    )
    ratio = ratio.select(F.lit("cache").alias("section"), F.lit("ratio").alias("name"), "n", "value", F.lit(None).cast("double").alias("last"))
    return rows.unionByName(ratio)
