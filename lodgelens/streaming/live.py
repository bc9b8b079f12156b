"""Review de-duplication and request counters as streams."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.language import with_language
from lodgelens.functions.values import event_order
from lodgelens.operators.cleaning import KEPT_LANGUAGES, clean_comments
from lodgelens.operators.ranking import keep_first
from lodgelens.operators.sketches import hourly_sketches
from lodgelens.session import stored_bytes
from lodgelens.streaming.best_rows import drain_best
from lodgelens.streaming.drain import drain_batches


def drain_unique(
    stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str
) -> DataFrame:
    """Append the first row of every key to ``path`` and return all that is there.

    Nothing but repeats is dropped, however late a row arrives: a batch keeps its first row per
    key in ``order`` and leaves out keys of earlier batches (nulls are equal, as in
    ``dropDuplicates``). Each batch has its own folder and overwrites it when it is repeated.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = keep_first(batch, keys, [F.col(c) for c in order])
        if batch_id and stored_bytes(spark, f"{path}/batch=*"):
            known = spark.read.option("basePath", path).parquet(path)
            known = known.filter(F.col("batch") < batch_id).select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            fresh = fresh.join(known, reduce(and_, same), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    drain_batches(stream, store, checkpoint)
    found = stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/batch=*")
    return found.select(*stream.columns)


def drain_silver_reviews(
    bronze: DataFrame,
    path: str,
    checkpoint: str,
    languages: tuple[str, ...] = KEPT_LANGUAGES,
    detector=None,
) -> DataFrame:
    """Bronze reviews to silver reviews as they arrive; the same rows as the batch form.

    Of several rows with one listing, reviewer and date the one with the lowest id of all stays,
    whichever batch brings it. ``path`` keeps the corrections (see ``best_rows``).
    """
    spoken = with_language(clean_comments(bronze), "comments", detector=detector)
    kept = spoken.filter(F.col("lang").isin(*languages))
    return drain_best(kept, ["listing_id", "reviewer_id", "date"], ["id", "comments"], path, checkpoint)


def running_counters(
    stream: DataFrame, phase: str, ms: str, ts: str, event_id: str, is_error
) -> DataFrame:
    """Per phase: number, errors, sum and last timing so far.

    Map-side partial sums feed the state, whose size is the number of phases.
    """
    order = event_order(F.col(ts), F.col(event_id))
    return stream.groupBy(F.col(phase).alias("phase")).agg(
        F.count("*").alias("n"),
        F.count_if(is_error).alias("errors"),
        F.bround(F.avg(ms), 1).alias("avg_ms"),
        F.bround(F.max_by(ms, order), 1).alias("last_ms"),
    )


def drain_counters(counters: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Bring the stored counters up to date and return them.

    Every batch overwrites the one small result folder with the running totals.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    drain_batches(counters, store, checkpoint, mode="complete")
    return counters.sparkSession.read.parquet(path)


def drain_sketches(stream: DataFrame, phase: str, ms: str, ts: str, identity: str, path: str, checkpoint: str) -> DataFrame:
    """Store the sketches of everything that is new and return all stored ones (see ``operators.sketches``).

    Each batch has its own folder and overwrites it when it is repeated, so counts stay exact.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        hourly_sketches(batch, phase, ms, ts, identity).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    drain_batches(stream, store, checkpoint)
    spark = stream.sparkSession
    schema = hourly_sketches(spark.createDataFrame([], stream.schema), phase, ms, ts, identity).schema
    if not stored_bytes(spark, f"{path}/batch=*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")
