"""Labelled query sets kept as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.functions.values import id_normalise
from lodgelens.schemas import QUERY_SET


def read_query_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries ``(query_id, query)`` and labels ``(query_id, listing_id)``.

    Each file is one JSON object with an array of queries; a large set is a folder of
    such files, read in parallel. Label ids are normalised to text, never through double.
    """
    doc = spark.read.schema(QUERY_SET).option("multiLine", True).json(path)
    entry = doc.select(F.explode("queries").alias("q")).select("q.*")
    queries = entry.select(F.col("id").alias("query_id"), "query")
    labels = entry.select(
        F.col("id").alias("query_id"), F.explode("relevant_listing_ids").alias("listing_id")
    ).select("query_id", id_normalise(F.col("listing_id")).alias("listing_id"))
    return queries, labels.distinct()


def write_query_set(queries: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Write ``(id, query, relevant_listing_ids)`` rows as query-set files of bounded size.

    Rows are dealt to files by a hash of their id, so no file grows with one hot key.
    """
    files = max(1, -(-queries.count() // rows_per_file))
    shard = F.pmod(F.xxhash64("id"), F.lit(files))
    packed = queries.groupBy(shard.alias("shard")).agg(
        F.collect_list(F.struct("id", "query", "relevant_listing_ids")).alias("queries")
    )
    packed.select(F.to_json(F.struct("queries")).alias("value")).repartition(files).write.option(
        "maxRecordsPerFile", 1
    ).text(path)
