"""Columns that are worked out once per row, whatever is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns, keeping their expressions out of later steps.

    The optimizer copies the expression behind a plain column into every filter it pushes
    below it, so a filter on the language of a text would tokenise the text once per use.
    The output of a generator is never copied: a one-element ``inline`` holds it in place,
    inside the same generated code. The columns must not depend on one another.
    """
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(packed))
