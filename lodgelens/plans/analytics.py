"""Logged or typed SQL: audited, run and previewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from lodgelens.operators.questions import result_preview
from lodgelens.operators.routing import audit_statements
from lodgelens.sources.tables import sql_query


class UnsafeStatement(ValueError):
    """A statement the audit rejects; the verdict is the message."""


def run_audited(spark: SparkSession, statement: str, **views: DataFrame) -> DataFrame:
    """Result of one SELECT text, if the audit passes it."""
    typed = spark.createDataFrame([(statement,)], "statement string")
    row = audit_statements(typed).first()
    if row["verdict"] != "ok":
        raise UnsafeStatement(row["verdict"])
    return sql_query(spark, row["clean_sql"], **views)


def preview_audited(
    spark: SparkSession, statement: str, order: list[Column], **views: DataFrame
) -> DataFrame:
    """Row count and markdown preview of an audited statement."""
    return result_preview(run_audited(spark, statement, **views), order)
