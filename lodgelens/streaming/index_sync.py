"""The retrieval index, brought up to date on demand from published changes.

The index is a base of unique chunks and a log of later row versions. A sync appends
only what changed, with vectors computed for changed texts only. Readers take the base
as it lies, without the few chunks the log replaces. Compaction writes the next base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelens.bounds import broadcast_if_small
from lodgelens.operators.embedding import Embedder, embed_text
from lodgelens.operators.ranking import keep_first
from lodgelens.schemas import INDEXED_COLUMNS
from lodgelens.streaming.drain import drain_batches, file_stream

VERSION = ["_change_type", "_version"]


def sync_index(
    spark: SparkSession,
    changes: str,
    schema: T.StructType,
    index: str,
    embedder: Embedder | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Process change files not seen before; return the index rows.

    A batch writes its own folder in overwrite mode, so a batch repeated after a failure
    replaces itself. Order between batches does not matter: rows carry their version.
    """
    columns = [c for c in INDEXED_COLUMNS if c in schema.fieldNames()]

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*columns, *VERSION)
        newest = keep_first(rows, ["chunk_id"], [F.desc("_version")])
        live = F.when(F.col("_change_type") != "delete", F.col("chunk_text"))
        vectors = embed_text(newest.withColumn("_live_text", live), "_live_text", embedder)
        vectors.drop("_live_text").write.mode("overwrite").parquet(f"{index}/log/b{batch_id:09d}")

    stream = file_stream(spark, changes, schema, files_per_batch)
    drain_batches(stream, append, f"{index}/checkpoint")
    return read_index(spark, index)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Sorted names below a folder of any file system Spark can reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    return sorted(entry.getPath().getName() for entry in files.listStatus(where))


def _parts(spark: SparkSession, index: str) -> tuple[str | None, list[str], int]:
    """Newest complete base, the log folders after it, and the last batch there is."""
    bases = [b for b in _children(spark, f"{index}/base")
             if "_SUCCESS" in _children(spark, f"{index}/base/{b}")]
    upto = int(bases[-1][1:]) if bases else -1
    batches = [b for b in _children(spark, f"{index}/log") if int(b[1:]) > upto]
    last = int(batches[-1][1:]) if batches else upto
    base = f"{index}/base/{bases[-1]}" if bases else None
    return base, [f"{index}/log/{b}" for b in batches], last


def _current(spark: SparkSession, index: str) -> DataFrame:
    """Live rows with their versions."""
    base, log, _ = _parts(spark, index)
    if base is None and not log:
        raise ValueError(f"no index at {index}")
    if not log:
        return spark.read.parquet(base)
    newest = keep_first(spark.read.parquet(*log), ["chunk_id"], [F.desc("_version")])
    live = newest.filter(F.col("_change_type") != "delete")
    if base is None:
        return live
    replaced = broadcast_if_small(spark.read.parquet(*log).select("chunk_id").distinct())
    return spark.read.parquet(base).join(replaced, "chunk_id", "left_anti").unionByName(live)


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """Current rows: the newest version per chunk, deleted ones left out."""
    return _current(spark, index).drop(*VERSION)


def compact_index(spark: SparkSession, index: str) -> DataFrame:
    """Write the current rows as the next base, without touching what readers use.

    A base counts once it is complete; superseded folders can be removed when no reader
    needs them any more.
    """
    _, log, last = _parts(spark, index)
    if log:
        _current(spark, index).write.mode("overwrite").parquet(f"{index}/base/u{last:09d}")
    return read_index(spark, index)
