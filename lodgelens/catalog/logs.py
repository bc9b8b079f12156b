"""Counters, ratios and latencies over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.catalog.registry import load, query
from lodgelens.operators import request_log
from lodgelens.session import scratch_path
from lodgelens.sources import metric_state

ERROR = "error"


def keyed_events(spark, folder):
    """Events with the key number out of their properties."""
    return load(spark, folder, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


def marked_events(spark, folder):
    events = keyed_events(spark, folder)
    succeeded = F.col("event_type") != ERROR
    return request_log.repeat_requests(events, ["user_id", "k"], "ts", "event_id", succeeded)


MARKED_SQL = """
    marked AS (SELECT *, coalesce(max(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (
                   PARTITION BY user_id, json_extract(props, '$.k')::INTEGER ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS hit FROM events)
"""


@query("repeat_requests", f"WITH {MARKED_SQL} SELECT event_id, user_id, hit FROM marked")
def repeat_requests(spark, folder):
    return marked_events(spark, folder).select("event_id", "user_id", "hit")


@query(
    "cache_ratio",
    f"""
    WITH {MARKED_SQL}
    SELECT count_if(hit)::BIGINT AS hits, count_if(NOT hit)::BIGINT AS misses,
           round_even(count_if(hit)::DOUBLE / count(*), 3) AS hit_ratio FROM marked
    """,
)
def cache_ratio(spark, folder):
    return request_log.cache_ratio(marked_events(spark, folder))


@query(
    "kpi_totals",
    f"""
    WITH {MARKED_SQL}
    SELECT count(*) AS requests,
           round(round_even(count_if(hit)::DOUBLE / count(*), 3) * 100, 0)::INTEGER AS hit_percent,
           round_even(avg(CASE WHEN event_type = 'purchase' THEN value END), 1) AS generation_ms,
           count_if(event_type = 'error')::BIGINT AS errors
    FROM marked
    """,
)
def kpi_totals(spark, folder):
    return request_log.kpi_totals(
        marked_events(spark, folder),
        "value",
        F.col("event_type") == "purchase",
        F.col("event_type") == ERROR,
    )


@query("intent_counts", "SELECT event_type AS intent, count(*) AS n FROM events GROUP BY event_type")
def intent_counts(spark, folder):
    return request_log.intent_counts(load(spark, folder, "events"), "event_type")


@query(
    "error_counts",
    "SELECT user_id AS place, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id",
)
def error_counts(spark, folder):
    events = load(spark, folder, "events")
    return request_log.error_counts(events, "user_id", F.col("event_type") == ERROR)


PHASE_SQL = """
    SELECT event_type AS phase, count(*) AS n, round_even(avg(value), 1) AS avg_ms,
           round_even(arg_max(value, (ts, event_id)), 1) AS last_ms
    FROM events GROUP BY event_type
"""


@query("phase_stats", PHASE_SQL)
def phase_stats(spark, folder):
    events = load(spark, folder, "events")
    return request_log.phase_stats(events, "event_type", "value", "ts", "event_id")


def _pick(p: float) -> str:
    return f"max(CASE WHEN pos = least(n - 1, round_even({p}::DOUBLE * (n - 1), 0)) THEN round_even(value, 1) END)"


@query(
    "latency_percentiles",
    f"""
    WITH r AS (SELECT event_type AS phase, value,
                      row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos,
                      count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT phase, max(n) AS n, {_pick(0.5)} AS p50, {_pick(0.95)} AS p95, {_pick(0.99)} AS p99,
           round_even(avg(value), 1) AS mean, round_even(max(value), 1) AS max
    FROM r GROUP BY phase
    """,
)
def latency_percentiles(spark, folder):
    return request_log.latency_percentiles(load(spark, folder, "events"), "event_type", "value")


@query(
    "keep_last_n",
    """
    SELECT event_id, event_type, value, age FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age
        FROM events) WHERE age <= 200
    """,
)
def keep_last_n(spark, folder):
    kept = request_log.keep_last(load(spark, folder, "events"), "event_type", "ts", "event_id")
    return kept.select("event_id", "event_type", "value", "age")


@query(
    "metrics_snapshot",
    f"""
    WITH {MARKED_SQL},
    kept AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age
             FROM events)
    SELECT 'intent' AS section, event_type AS name, count(*) AS n, NULL::DOUBLE AS value, NULL::DOUBLE AS last
    FROM events GROUP BY event_type
    UNION ALL SELECT 'error', event_type, count(*), NULL, NULL FROM events WHERE event_type = 'error' GROUP BY event_type
    UNION ALL SELECT 'cache', CASE WHEN hit THEN 'hit' ELSE 'miss' END AS outcome, count(*), NULL, NULL FROM marked GROUP BY outcome
    UNION ALL SELECT 'cache', 'ratio', count(*), round_even(count_if(hit)::DOUBLE / count(*), 3), NULL FROM marked
    UNION ALL SELECT 'phase', event_type, count(value), round_even(avg(value), 1),
                     round_even(max(CASE WHEN age = 1 THEN value END), 1)
              FROM kept WHERE age <= 200 GROUP BY event_type
    """,
)
def metrics_snapshot(spark, folder):
    """Everything the counters know, out of the saved state."""
    path = scratch_path(spark, "metrics")
    state = request_log.metric_state(
        marked_events(spark, folder), "event_type", "value", "ts", "event_id", F.col("event_type") == ERROR
    )
    metric_state.save_state(state, path)
    return request_log.metrics_snapshot(metric_state.load_state(spark, path))
