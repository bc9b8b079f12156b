"""The question shapes asked over listings, as parameterised frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _contains(column: str, text: str) -> Column:
    """Case-blind substring test; ``%`` and ``_`` of the text count as such."""
    literal = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"%{literal}%")


def ilike_contains(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(_contains(column, text))


def average_by_group(df: DataFrame, group: str, value: str, digits: int = 2) -> DataFrame:
    """Rows and rounded mean per group."""
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg(value), digits).alias(f"avg_{value}")
    )


def average_where(df: DataFrame, column: str, text: str, value: str, digits: int = 2) -> DataFrame:
    mean = F.round(F.avg(value), digits).alias(f"avg_{value}")
    return ilike_contains(df, column, text).agg(mean)


def count_where(df: DataFrame, column: str, text: str) -> DataFrame:
    return ilike_contains(df, column, text).agg(F.count("*").alias("n"))


def extremes_where(df: DataFrame, column: str, text: str, value: str) -> DataFrame:
    return ilike_contains(df, column, text).agg(
        F.max(value).alias(f"max_{value}"), F.min(value).alias(f"min_{value}")
    )


def top_groups(df: DataFrame, group: str, n: int = 5) -> DataFrame:
    """The ``n`` groups with most rows; the name breaks ties."""
    counted = df.groupBy(group).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.asc(group)).limit(n)


def groups_over(df: DataFrame, group: str, threshold: int) -> DataFrame:
    """How many groups have more than ``threshold`` rows."""
    counted = df.groupBy(group).agg(F.count("*").alias("rows_in_group"))
    return counted.filter(F.col("rows_in_group") > threshold).agg(F.count("*").alias("n"))


def lookup(df: DataFrame, column: str, text: str, *columns: str) -> DataFrame:
    """The wanted columns of rows whose name contains ``text``."""
    return ilike_contains(df, column, text).select(*columns)


def extreme_rows(
    df: DataFrame, value: str, key: str, n: int = 1, highest: bool = False
) -> DataFrame:
    """The cheapest or dearest ``n`` rows; the key breaks ties."""
    direction = F.desc_nulls_last(value) if highest else F.asc_nulls_last(value)
    return df.orderBy(direction, F.asc(key)).limit(n)


def distribution(df: DataFrame, group: str, digits: int = 4) -> DataFrame:
    """Rows per group and their share of all rows.

    The total is a scalar subquery, so the groups stay distributed; a window over all
    groups would pull them into one task.
    """
    total = df.agg(F.count("*").alias("total")).scalar()
    counted = df.groupBy(group).agg(F.count("*").alias("n"))
    return counted.select(group, "n", F.round(F.col("n") / total, digits).alias("share"))


def scope_subset(df: DataFrame, column: str, chosen: str | None) -> DataFrame:
    """Rows of the chosen place; all rows when none is chosen."""
    return df.filter(F.col(column) == chosen) if chosen else df


def result_preview(df: DataFrame, order: list[Column], limit: int = 20) -> DataFrame:
    """Row count and a markdown table of the first rows in ``order``, as one row.

    Only the first ``limit`` rows meet in one task; the count is a separate aggregate.
    """
    columns = df.columns
    line = F.concat_ws(
        " | ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]
    )
    # The rows are in one task after the limit, so this window moves at most `limit` rows.
    position = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    top = df.orderBy(*order).limit(limit).select(position.alias("pos"), line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    body = top.agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("body"))
    head = " | ".join(columns) + "\n" + " | ".join("---" for _ in columns) + "\n"
    total = df.agg(F.count("*").alias("n")).scalar()
    text = F.when(total > 0, F.concat(F.lit(head), F.col("body"))).otherwise("(nessuna riga)")
    return body.select(text.alias("preview"), total.alias("row_count"))
