"""Streams drained over files made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.catalog.ingest import chunk_versions
from lodgelens.catalog.logs import PHASE_SQL
from lodgelens.catalog.registry import load, query
from lodgelens.catalog.retrieval import DOC_VECTORS_SQL
from lodgelens.operators import chunks as chunk_ops
from lodgelens.operators import sketches as sketch_ops
from lodgelens.operators.versions import VersionedTable
from lodgelens.schemas import CHUNKS
from lodgelens.session import materialise, scratch_path
from lodgelens.streaming.best_rows import drain_best
from lodgelens.streaming.drain import drain_to_parquet, file_stream
from lodgelens.streaming.index_sync import sync_index
from lodgelens.streaming.live import drain_counters, drain_sketches, drain_unique, running_counters


def document_chunks(spark, folder):
    return load(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("doc_id").alias("listing_id"),
        F.lit("rome").alias("city"),
        F.col("lang").alias("neighbourhood"),
        F.col("source").alias("room_type"),
        F.lit("2024-01-01").alias("review_date"),
        F.col("text").alias("chunk_text"),
        F.lit(1).alias("token_count"),
    ).select(*CHUNKS.fieldNames())


@query(
    "triggered_sync",
    f"""
    WITH {DOC_VECTORS_SQL}
    SELECT doc_id::VARCHAR AS chunk_id, lang AS neighbourhood, source AS room_type,
           md5(text) AS digest, doc_id IN (SELECT id FROM d_norms) AS has_vector
    FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1
    """,
)
def triggered_sync(spark, folder):
    """Three published versions, synced after the first and after the last."""
    docs = document_chunks(spark, folder)
    toxic = load(spark, folder, "labels").filter("toxic = 1").select(
        F.col("doc_id").cast("string").alias("chunk_id")
    )
    root, index = scratch_path(spark, "gold"), scratch_path(spark, "index")
    first = docs.filter("neighbourhood <> 'fr'").withColumn("chunk_text", F.upper("chunk_text"))
    changes = chunk_ops.publish_version(first, root, 1)
    sync_index(spark, f"{root}/changes", changes.schema, index)
    chunk_ops.publish_version(docs, root, 2, previous=1)
    chunk_ops.publish_version(docs.join(toxic, "chunk_id", "left_anti"), root, 3, previous=2)
    rows = sync_index(spark, f"{root}/changes", changes.schema, index)
    return rows.select(
        "chunk_id",
        "neighbourhood",
        "room_type",
        F.md5("chunk_text").alias("digest"),
        F.col("embedding").isNotNull().alias("has_vector"),
    )


@query(
    "change_stream",
    """
    WITH docs AS (SELECT doc_id::VARCHAR AS chunk_id, lang, text, quality, toxic
                  FROM documents LEFT JOIN labels USING (doc_id)),
    old AS (SELECT chunk_id, lang, text FROM docs WHERE coalesce(quality, 1) <> 0),
    new AS (SELECT chunk_id, lang, CASE WHEN quality = 1 AND lang = 'en' THEN lower(text) ELSE text END AS text
            FROM docs WHERE coalesce(toxic, 0) <> 1),
    moves AS (
        SELECT 2 AS v, o.chunk_id AS o_id, o.lang AS o_lang, o.text AS o_text, n.chunk_id AS n_id, n.lang AS n_lang,
               n.text AS n_text FROM old o FULL JOIN new n ON o.chunk_id = n.chunk_id
        UNION ALL
        SELECT 3, n.chunk_id, n.lang, n.text, o.chunk_id, o.lang, o.text FROM old o FULL JOIN new n ON o.chunk_id = n.chunk_id)
    SELECT v::BIGINT AS version, coalesce(n_id, o_id) AS chunk_id, coalesce(n_lang, o_lang) AS lang,
           md5(CASE WHEN n_id IS NULL THEN o_text ELSE n_text END) AS digest,
           CASE WHEN o_id IS NULL THEN 'insert' WHEN n_id IS NULL THEN 'delete' ELSE 'update' END AS change
    FROM moves WHERE o_id IS NULL OR n_id IS NULL OR o_text <> n_text
    """,
)
def change_stream(spark, folder):
    """Three versions, the third as the first; followed from version 2 on, with a restart before version 3."""
    old, new = chunk_versions(spark, folder)
    table = VersionedTable(spark, scratch_path(spark, "versions"), new.schema, buckets=32)
    out, state = scratch_path(spark, "followed"), scratch_path(spark, "followed-state")
    table.publish(old, 1)
    table.publish(new, 2, previous=1)
    drain_to_parquet(table.change_stream(2), out, state)
    table.publish(old, 3, previous=2)
    stream = table.change_stream(2)
    drain_to_parquet(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out).select(
        F.col("_version").alias("version"), "chunk_id", "lang", F.md5("text").alias("digest"), F.col("_change_type").alias("change")
    )


def _event_files(spark, folder, drops: int, files: int = 0) -> tuple[str, object]:
    events = load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "events")
    if files:
        events = events.repartition(files, F.xxhash64("event_id"))
    for drop in range(drops):
        events.write.parquet(f"{path}/drop{drop}")
    return path, events.schema


@query("stream_review_dedup", "SELECT event_id, user_id, event_type, value FROM events")
def stream_review_dedup(spark, folder):
    """The events arrive twice in eight files, in no order of time; each event comes out once."""
    path, schema = _event_files(spark, folder, 2, files=8)
    stream = file_stream(spark, path, schema, files_per_batch=1)
    picked = stream.select("event_id", "user_id", "event_type", "value", "ts")
    out = scratch_path(spark, "unique")
    return drain_unique(picked, ["event_id"], ["ts"], out, scratch_path(spark, "unique-state")).drop("ts")


@query(
    "stream_best_rows",
    """
    SELECT user_id, event_type, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts NULLS FIRST, event_id NULLS FIRST) = 1
    """,
)
def stream_best_rows(spark, folder):
    """Each user's first event of a type; later files bring earlier events, so rows are corrected."""
    events = load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "events")
    # One file per stretch of time, the latest first.
    stretches = events.repartitionByRange(4, F.col("ts").desc())
    stretches.write.parquet(f"{path}/drop0")
    stretches.write.parquet(f"{path}/drop1")
    stream = file_stream(spark, path, events.schema, files_per_batch=2).select("user_id", "event_type", "event_id", "ts", "value")
    return drain_best(
        stream, ["user_id", "event_type"], ["ts", "event_id"], scratch_path(spark, "best"), scratch_path(spark, "best-state")
    )


@query(
    "stream_counters",
    f"""
    SELECT phase, n, avg_ms, last_ms, CASE WHEN phase = 'error' THEN n ELSE 0 END AS errors
    FROM ({PHASE_SQL})
    """,
)
def stream_counters(spark, folder):
    path, schema = _event_files(spark, folder, 1)
    counters = running_counters(
        file_stream(spark, path, schema),
        "event_type",
        "value",
        "ts",
        "event_id",
        F.col("event_type") == "error",
    )
    return drain_counters(
        counters, scratch_path(spark, "counters"), scratch_path(spark, "counters-state")
    )


@query(
    "stream_sketches",
    """
    SELECT event_type AS phase, count(*) AS n, count(value) AS n_timed, true AS p50_near, true AS p95_near,
           true AS p99_near, true AS users_near FROM events GROUP BY event_type
    """,
)
def stream_sketches(spark, folder):
    """Sketches stored batch by batch and merged; each estimate against the whole log, within its bound."""
    path, schema = _event_files(spark, folder, 1, files=4)
    stored = drain_sketches(
        file_stream(spark, path, schema, files_per_batch=2),
        "event_type",
        "value",
        "ts",
        "user_id",
        scratch_path(spark, "sketches"),
        scratch_path(spark, "sketches-state"),
    )
    found = materialise(sketch_ops.report(stored).withColumnRenamed("phase", "_phase"), "sketch-report")
    events = load(spark, folder, "events")
    joined = events.join(found, events["event_type"].eqNullSafe(found["_phase"]))

    def near(p: int):
        low, high = (F.count_if(c) / F.max("n_timed") for c in (F.col("value") < F.col(f"p{p}"), F.col("value") <= F.col(f"p{p}")))
        close = (low <= p / 100 + sketch_ops.RANK_BOUND) & (high >= p / 100 - sketch_ops.RANK_BOUND)
        return F.coalesce(close, F.max("n_timed") == 0).alias(f"p{p}_near")

    users = F.countDistinct("user_id")
    return joined.groupBy(F.col("_phase").alias("phase")).agg(
        F.max("n").alias("n"),
        F.max("n_timed").alias("n_timed"),
        *map(near, (50, 95, 99)),
        (F.abs(F.max("identities") - users) <= sketch_ops.COUNT_BOUND * users).alias("users_near"),
    )
