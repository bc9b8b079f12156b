"""Language vote by common words, without a Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.once import with_once

#: Shorter texts (in characters) carry no reliable signal.
MIN_CHARS = 12

# Frequent function words per language; a word may serve several languages.
STOP_WORDS = {
    "en": "the and of to in is was it for with that are we very this",
    "it": "il di che è la un per non con molto della del ci sono gli",
    "es": "el la de que y en los muy con para las una por del está",
    "fr": "le la de et les des un une est pour dans très nous du que",
    "de": "der die und das ist nicht ein eine mit sehr von den zu wir auch",
}


def language_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def language_hits(tokens: Column) -> Column:
    """Number of common words per language, in ``STOP_WORDS`` order."""

    def hits(vocabulary: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(vocabulary)))

    return F.array(*[hits(spec.split()) for spec in STOP_WORDS.values()])


def language_vote(hits: Column) -> Column:
    """Language with most hits, the first on a tie; ``unknown`` without any hit."""
    codes = F.array(*[F.lit(code) for code in STOP_WORDS])
    best = F.array_max(hits)
    return F.when(best > 0, F.element_at(codes, F.array_position(hits, best).cast("int")))


def with_language(
    df: DataFrame,
    text: str,
    out: str = "lang",
    detector: Callable[[pd.Series], pd.Series] | None = None,
) -> DataFrame:
    """Add a language column by the common-word vote or by a plug-in ``detector``.

    A detector sees Arrow batches of text and returns one code per text; texts
    that are null or too short never reach its verdict.
    """
    long_enough = F.length(text) > MIN_CHARS
    if detector is None:
        # Step by step, as each step is used several times by the next one. Holding the
        # last one in place is enough: no filter gets below it.
        tokens = F.when(long_enough, language_tokens(F.col(text)))
        split = df.withColumn("_tokens", tokens)
        counted = split.withColumn("_hits", language_hits(F.col("_tokens"))).drop("_tokens")
        vote = F.coalesce(language_vote(F.col("_hits")), F.lit("unknown"))
        return with_once(counted, {out: vote}).drop("_hits")

    @F.pandas_udf("string")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield detector(batch.fillna(""))

    # Not to be run a second time by a filter on its result.
    detect = detect.asNondeterministic()
    return df.withColumn(
        out, F.when(long_enough, F.coalesce(detect(text), F.lit("unknown"))).otherwise("unknown")
    )
