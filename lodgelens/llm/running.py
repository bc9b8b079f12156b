"""Positions and running combinations inside groups of any size, without a task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.session import materialise


def numbered(rows: DataFrame, key: str, order: list[str], xors: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``pos`` (from 0 inside each ``key``, in ``order``) and running xors of ``xors``.

    Rows are dealt by range over key and order, so a key with a third of all rows is spread over many
    tasks; each range counts on its own and is shifted by what the ranges before it hold of the key.
    Only one row per range and key is gathered for that. ``xors`` are long columns; they are replaced
    by the exclusive or of all their values up to and with the row. Keys must not be null.
    """
    placed = materialise(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(key, "_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = placed.groupBy(key, "_range").agg(F.count("*").alias("_n"), *(F.bit_xor(c).alias(f"_{c}") for c in xors))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = part.select(
        key,
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        *(F.coalesce(F.bit_xor(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in xors),
    )
    counted = placed.withColumns({"_at": F.row_number().over(inside) - 1, **{c: F.bit_xor(c).over(upto) for c in xors}})
    kept = [c for c in rows.columns if c not in xors]
    return counted.join(shift, [key, "_range"]).select(
        *kept, (F.col("_at") + F.col("_n")).alias("pos"), *(F.col(c).bitwiseXOR(F.col(f"_{c}")).alias(c) for c in xors)
    )
