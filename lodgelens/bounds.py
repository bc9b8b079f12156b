"""Size checks that must pass before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A frame is broadcast only when its measured values take at most this much.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _width(field: T.StructField):
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long") + 24
    if isinstance(field.dataType, T.ArrayType):
        inner = F.size(col).cast("long") * 8
        if isinstance(field.dataType.elementType, T.StringType):
            inner = F.octet_length(F.array_join(col, "")).cast("long") + F.size(col) * 24
        return F.coalesce(inner, F.lit(0)) + 24
    return F.lit(16).cast("long")


def measured_bytes(df: DataFrame) -> int:
    """Sum of the value sizes of ``df``, from one distributed aggregate."""
    width = sum((_width(f) for f in df.schema.fields), F.lit(0).cast("long"))
    return int(df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0])


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    return measured_bytes(df) <= (MAX_BROADCAST_BYTES if max_bytes is None else max_bytes)


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Hint a broadcast when the measured size allows it, else leave the join to AQE."""
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df
