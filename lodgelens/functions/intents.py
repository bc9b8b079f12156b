"""Keyword intent labels and the scope override."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known labels, in the order they are offered.
INTENTS = ["conversational", "rag", "analytics"]

# Phrases that mark a question about numbers.
ANALYTICS_PHRASES = [
    "prezzo", "prezzi", "media", "medio", "quanti", "quante", "numero", "conteggio", "max", "min",
    "massimo", "minimo", "average", "price", "count", "how many", "most expensive", "cheapest",
    "per quartiere", "per zona", "distribuzione",
]

# Phrases that mark a question about guest experience.
REVIEW_PHRASES = [
    "recension", "opinion", "esperienz", "com'è", "come è", "consigli", "rumore", "pulizia",
    "zona tranquilla", "review", "clean", "noisy", "safe", "neighborhood vibe", "host",
]

# Stems that keep a scoped question analytic; matched anywhere in the text.
SCOPED_ANALYTICS_STEMS = [
    "prezz", "medi", "quant", "numero", "conteggio", "massim", "minim", "percentu", "costo",
    "economic", "caro", "disponibil", "notti", "recension.*(quant|numero)", "più caro",
    "più costoso",
]

_EDGE = r"[^\p{L}\p{N}_]"


def whole_phrase_pattern(phrases: list[str]) -> str:
    """Pattern for any phrase with word edges that know accented letters."""
    return f"(^|{_EDGE})({'|'.join(phrases)})($|{_EDGE})"


def stem_pattern(phrases: list[str]) -> str:
    """Like :func:`whole_phrase_pattern`, but a word may go on after the phrase."""
    return f"(^|{_EDGE})({'|'.join(phrases)})"


def intent_label(query: Column, inflected: bool = False) -> Column:
    """Label by keywords: analytics first, then rag, else conversational.

    The stems among the review phrases only match as whole words, so an inflected
    form goes unnoticed; ``inflected=True`` accepts any ending for those phrases.
    """
    text = F.lower(query)
    review = (stem_pattern if inflected else whole_phrase_pattern)(REVIEW_PHRASES)
    return (
        F.when(text.rlike(whole_phrase_pattern(ANALYTICS_PHRASES)), "analytics")
        .when(text.rlike(review), "rag")
        .otherwise("conversational")
    )


def intent_from_json(raw: Column, query: Column) -> Column:
    """Label named in a classifier's reply if it is a known one, else the keyword label."""
    named = F.regexp_extract(raw, r'"intent"\s*:\s*"(\w+)"', 1)
    field = F.get_json_object(raw, "$.intent")
    return (
        F.when(named.isin(INTENTS), named)
        .when(field.isin(INTENTS), field)
        .otherwise(intent_label(query))
    )


def scope_override(intent: Column, query: Column, scoped: Column) -> Column:
    """A scoped question without a numeric stem is about reviews, whatever its label."""
    numeric = F.lower(query).rlike("|".join(SCOPED_ANALYTICS_STEMS))
    return F.when(scoped & ~numeric, "rag").otherwise(intent)
