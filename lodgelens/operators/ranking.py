"""Top rows per key, without one task per hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Above this depth a hot key gets a second, salted level (see ``top_per_key``).
SALTED_DEPTH = 100
SALTS = 16


def top_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    tie: str,
    rank: str = "rank",
) -> DataFrame:
    """The first ``k`` rows per key in ``order`` and then by ``tie``, ranked from 1.

    Spark limits each map partition to ``k`` rows per key before the shuffle
    (WindowGroupLimit), which is enough while ``k`` is small. For deep lists what the map
    partitions keep of a key is first ranked in ``SALTS`` slices of partitions, so the rows of a
    hot key go through many tasks and the last one sees at most ``SALTS * k`` of them.
    """
    order = [*order, F.col(tie).asc()]
    if k > SALTED_DEPTH:
        salted = df.withColumn("_salt", F.spark_partition_id() % SALTS)
        slice_rank = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
        df = salted.withColumn(rank, slice_rank).filter(F.col(rank) <= k).drop("_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    Only the best row per key and map partition is shuffled, so a third of the table
    being copies of one row costs one row per partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(window)).filter("_first = 1").drop("_first")
