"""Review chunks and the changes between two versions of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.bounds import fits_broadcast
from lodgelens.functions.text import token_estimate
from lodgelens.functions.values import stable_key
from lodgelens.session import materialise


def with_listing_columns(reviews: DataFrame, listings: DataFrame) -> DataFrame:
    """Left join on listing and city: reviews of dropped listings keep null columns."""
    columns = listings.select(F.col("id").alias("listing_id"), "city", "neighbourhood", "room_type")
    return reviews.join(columns, ["listing_id", "city"], "left")


def build_chunks(reviews: DataFrame, listings: DataFrame) -> DataFrame:
    """One chunk per review.

    The key is a hash of what makes a review unique, so a rerun over the same reviews
    yields the same keys and the change feed shows real changes only.
    """
    joined = with_listing_columns(reviews, listings)
    return joined.select(
        stable_key(F.col("listing_id"), F.col("reviewer_id"), F.col("date")).alias("chunk_id"),
        "listing_id",
        "city",
        "neighbourhood",
        "room_type",
        F.col("date").alias("review_date"),
        F.col("comments").alias("chunk_text"),
        token_estimate(F.col("comments")).alias("token_count"),
    ).filter(F.length("chunk_text") > 0)


def _signature(df: DataFrame, key: str, columns: list[str], out: str) -> DataFrame:
    """Key and SHA-256 of the other columns; nulls are spelled out, so they count."""
    content = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.select(key, F.sha2(content, 256).alias(out))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows inserted, updated or deleted from ``old`` to ``new``, with ``_change_type``.

    Both versions are compared by key and content hash, so the texts stay where they are.
    The changed keys then fetch their rows: by broadcast if they are few, which is the
    usual case between two versions, else by a join on the key.
    """
    columns = [c for c in new.columns if c != key]
    before = _signature(old, key, columns, "_old")
    after = _signature(new, key, columns, "_new")
    change = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(F.col("_old") != F.col("_new"), "update")
    )
    compared = before.join(after, key, "full_outer").select(key, change.alias("_change_type"))
    changed = materialise(compared.filter(F.col("_change_type").isNotNull()), "changed-keys")
    small = fits_broadcast(changed)

    def rows(df: DataFrame, kept: DataFrame) -> DataFrame:
        return df.join(F.broadcast(kept) if small else kept, key).select(
            key, *columns, "_change_type"
        )

    gone = F.col("_change_type") == "delete"
    return rows(new, changed.filter(~gone)).unionByName(rows(old, changed.filter(gone)))


def publish_version(
    chunks: DataFrame, root: str, version: int, previous: int | None = None
) -> DataFrame:
    """Write one version of the chunk table and its change rows; return the changes.

    Both folders are overwritten, so a failed run can simply be repeated.
    """
    spark: SparkSession = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{root}/data/v{version:06d}")
    new = spark.read.schema(chunks.schema).parquet(f"{root}/data/v{version:06d}")
    if previous is None:
        changes = new.withColumn("_change_type", F.lit("insert"))
    else:
        old = spark.read.schema(chunks.schema).parquet(f"{root}/data/v{previous:06d}")
        changes = snapshot_diff(old, new)
    target = f"{root}/changes/v{version:06d}"
    stamped = changes.withColumn("_version", F.lit(version).cast("bigint"))
    stamped.write.mode("overwrite").parquet(target)
    return spark.read.schema(stamped.schema).parquet(target)
