"""Audit of logged SQL statements: one verdict per statement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgelens.functions.intents import whole_phrase_pattern
from lodgelens.functions.text import strip_space

# Words that may not occur in a statement.
FORBIDDEN_WORDS = [
    "insert", "update", "delete", "drop", "alter", "create", "attach", "copy", "pragma", "replace",
    "truncate", "grant", "revoke", "call", "export", "install", "load", "set", "merge",
]


def unfenced_sql(statement: Column) -> Column:
    """Statement without a code fence around it and without closing semicolons."""
    body = strip_space(F.regexp_replace(strip_space(statement), "(?i)^```(sql)?", ""))
    body = strip_space(F.regexp_replace(body, "```$", ""))
    return strip_space(F.regexp_replace(body, ";+$", ""))


def audit_verdict(clean: Column) -> Column:
    """``ok`` or the first rule an unfenced statement breaks."""
    head = F.lower(F.regexp_replace(clean, r"^\(+", ""))
    return (
        F.when(F.coalesce(clean, F.lit("")) == "", "empty")
        .when(clean.contains(";"), "multiple")
        .when(~(head.startswith("select") | head.startswith("with")), "not_select")
        .when(F.lower(clean).rlike(whole_phrase_pattern(FORBIDDEN_WORDS)), "forbidden_word")
        .otherwise("ok")
    )
