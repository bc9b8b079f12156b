"""Session defaults and the scratch location shared by every executor."""

from __future__ import annotations

import tempfile
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stream state on local disk and in the checkpoint instead of the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(
    app_name: str = "lodgelens",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the defaults above; ``extra`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="lodgelens-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``.

    The cluster names that folder and every executor reaches it. Only a local
    session with the setting unset falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_scratch()
    return f"{root.rstrip('/')}/lodgelens/{label}-{uuid4().hex}"


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """Size of files or folders on any file system Spark can reach; globs are allowed."""
    total = 0
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        for entry in files.globStatus(where) or []:
            total += files.getContentSummary(entry.getPath()).getLength()
    return total


def size_shuffles(spark: SparkSession, input_bytes: int, per_task: int = 256 * 1024 * 1024) -> int:
    """Set the number of shuffle partitions so that one holds about ``per_task`` bytes.

    AQE merges small partitions but cannot split a plain one, so large inputs need the
    number up front. Never below twice the cores.
    """
    least = 2 * spark.sparkContext.defaultParallelism
    wanted = max(least, -(-input_bytes // per_task))
    spark.conf.set("spark.sql.shuffle.partitions", wanted)
    return wanted


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage like a checkpoint does, but keeps parquet's column pruning
    and filters for the readers, and survives the loss of any executor. ``compression``
    is parquet's; None takes the session's.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_few_splits(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan by ``keys`` if it would leave half of the cores idle.

    A table of one small file runs a costly expression on one core. A table with many
    splits is returned untouched, so no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])
