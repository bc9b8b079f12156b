"""Cleaning, tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that make up a word, with and without digits.
WORD_PATTERN = r"([a-z0-9àèéìòùáéíóú&]+)"
LETTERS_PATTERN = r"([a-zàèéìòùáéíóú]+)"

# Common words that do not identify a listing on their own.
COMMON_NAME_WORDS = [
    "a", "e", "i", "o", "il", "la", "le", "lo", "gli", "un", "una", "uno", "di", "del", "della",
    "dei", "delle", "con", "per", "in", "su", "da", "che", "non", "si", "ci", "al", "alla",
    "the", "and", "with", "of", "in", "near", "room", "rooms", "apartment", "apt", "flat",
    "house", "home", "casa", "roma", "rome", "studio", "cozy", "b&b", "alloggio",
    "appartamento", "stanza", "cosa", "dove", "prezzo", "trova", "dicono", "villa", "suite",
    "loft", "attico", "residenza", "residence", "palazzo", "guesthouse", "camera", "monolocale",
    "bilocale", "dell", "sull", "che", "come",
]


def strip_space(c: Column) -> Column:
    """Remove white space of any script from both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"<[^>]+>", " "))


def squash_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def token_estimate(c: Column) -> Column:
    """Pieces between white space times 1.3, cut to an integer."""
    return (F.size(F.split(c, r"\s+")) * F.lit(1.3)).cast("int")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), F.lit(1))


def letter_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(LETTERS_PATTERN), F.lit(1))


def ngrams(tokens: Column, low: int = 2, high: int = 5, common=COMMON_NAME_WORDS) -> Column:
    """Phrases of ``low``..``high`` words, without those made of common words only.

    ``tokens`` must be a stored column: an expression would be evaluated again for
    every window inside the lambdas.
    """
    common = sorted(set(common))

    def windows(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
        cut = F.transform(starts, lambda i: F.slice(tokens, i, F.lit(n)))
        return F.when(F.size(tokens) >= n, cut).otherwise(F.array().cast("array<array<string>>"))

    grams = F.concat(*[windows(n) for n in range(low, high + 1)])
    telling = F.filter(grams, lambda g: F.exists(g, lambda w: ~w.isin(common)))
    return F.transform(telling, lambda g: F.array_join(g, " "))
