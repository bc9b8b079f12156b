"""Metric state saved to and loaded from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.schemas import METRIC_STATE, flat_schema

#: One row per counter, or per kept timing: kind, name, position in the list, value.
STATE_ROW = flat_schema("kind string, name string, seq long, value double")


def save_state(state: DataFrame, path: str) -> None:
    """Write state rows as JSON lines; rows scale where one JSON object would not."""
    state.select(*[F.col(f.name).cast(f.dataType) for f in STATE_ROW.fields]).write.json(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE_ROW).json(path)


def load_state_object(spark: SparkSession, path: str) -> DataFrame:
    """Read the single-object form (maps and lists) of the state into the same rows."""
    doc = spark.read.schema(METRIC_STATE).option("multiLine", True).json(path)
    counters = [
        doc.select(F.lit(kind).alias("kind"), F.explode(field).alias("name", "value"))
        for kind, field in (("intent", "intent_counts"), ("error", "errors"))
    ]
    caches = [
        doc.select(F.lit("cache").alias("kind"), F.lit(name).alias("name"), F.col(field).alias("value"))
        for name, field in (("hit", "cache_hits"), ("miss", "cache_misses"))
    ]
    flat = [
        part.select("kind", "name", F.lit(1).cast("bigint").alias("seq"), F.col("value").cast("double"))
        for part in counters + caches
    ]
    timings = doc.select(F.explode("phase_timings").alias("name", "list")).select(
        F.lit("phase").alias("kind"), "name", F.posexplode("list").alias("seq", "value")
    )
    rows = timings.select("kind", "name", (F.col("seq") + 1).cast("bigint").alias("seq"), "value")
    for part in flat:
        rows = rows.unionByName(part)
    return rows
