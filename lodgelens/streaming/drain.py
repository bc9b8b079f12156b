"""File streams read until what is there is processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000, recursive: bool = True
) -> DataFrame:
    """Parquet files as they appear under ``path``, sub-folders included.

    Unless ``recursive``, only partition folders (``name=value``), whose columns are filled in.
    """
    return (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", recursive)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available to ``path``, exactly once, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Hand everything available to ``handle`` batch by batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
