"""Tables by name, required columns and column listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite_table(
    df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None
) -> DataFrame:
    """Replace table ``name`` by ``df`` and return the stored table.

    Counting the result reads the stored files; the plan that made them runs once.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail before any job runs if a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def describe_columns(spark: SparkSession, table: str) -> DataFrame:
    """Column names and types of a table or view."""
    return spark.sql(f"DESCRIBE {table}").select("col_name", "data_type")


def sql_query(spark: SparkSession, statement: str, **views: DataFrame) -> DataFrame:
    """Run a SELECT text over the given frames, registered under their keyword names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement)


def row_counts(**frames: DataFrame) -> DataFrame:
    """One row per named frame with its number of rows."""
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n")
        for name, df in frames.items()
    ]
    total = counts[0]
    for part in counts[1:]:
        total = total.unionByName(part)
    return total
