"""Vectors for texts, by a plug-in model or by feature hashing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelens.functions.text import WORD_PATTERN, words


#: Characters of texts whose words are hashed at once.
PART_CHARS = 1 << 20


class Embedder(Protocol):
    """A plug-in model. ``load`` runs once per Python worker, ``embed`` once per batch."""

    def load(self) -> None: ...

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row per text; a text without a vector gets a row of zeros."""


class HashingEmbedder:
    """Signed word counts hashed to ``dim`` buckets; needs no model and no corpus pass.

    The bucket and the sign come from the word's MD5 digest: first eight hex digits
    modulo ``dim``, and whether the ninth is below 8.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def load(self) -> None:
        self.pattern = re.compile(WORD_PATTERN)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        # The words of a part only are held as strings.
        part = np.cumsum([len(t) for t in texts], dtype=np.int64) // PART_CHARS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if texts else [0]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            out[start:stop] = self._embed(texts[start:stop])
        return out

    def _embed(self, texts: list[str]) -> np.ndarray:
        found = [self.pattern.findall(t.lower()) for t in texts]
        lengths = [len(f) for f in found]
        out = np.zeros((len(texts), self.dim))
        if not sum(lengths):
            return out
        codes, vocabulary = pd.factorize(np.array([w for f in found for w in f], dtype=object))
        digests = [hashlib.md5(w.encode()).hexdigest() for w in vocabulary]
        bucket = np.array([int(d[:8], 16) % self.dim for d in digests])
        sign = np.array([1.0 if d[8] < "8" else -1.0 for d in digests])
        row = np.repeat(np.arange(len(texts)), lengths)
        flat = np.bincount(
            row * self.dim + bucket[codes], weights=(sign * self.weigh(digests))[codes], minlength=out.size
        )
        return flat.reshape(out.shape)

    def weigh(self, digests: list[str]) -> np.ndarray | float:
        """What one occurrence of each word counts."""
        return 1.0


class WeightedEmbedder(HashingEmbedder):
    """Hashed words that count the more, the fewer texts of a table hold them.

    ``rarity`` comes from ``fit_rarity``. More buckets than in the unweighted form keep rare words,
    which now decide, apart.
    """

    def __init__(self, rarity: np.ndarray, dim: int = 256):
        super().__init__(dim)
        self.rarity = rarity

    def weigh(self, digests: list[str]) -> np.ndarray:
        return self.rarity[[int(d[:8], 16) % len(self.rarity) for d in digests]]


def fit_rarity(df: DataFrame, text: str, slots: int = 1 << 18) -> np.ndarray:
    """Inverse document frequency per slot of word digests: ``ln((n + 1) / (df + 1)) + 1``.

    ``n`` counts the texts that are not null. Each text counts once per slot, before the shuffle by
    partial sums; what reaches the driver is bounded by ``slots`` numbers. Words that share a slot
    share their weight.
    """
    slot = F.transform(words(F.col(text)), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % slots)
    held = df.filter(F.col(text).isNotNull()).select(F.array_distinct(slot).alias("slots"))
    counts = held.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("df")).collect()
    n = held.count()
    out = np.full(slots, np.log(n + 1) + 1)
    for row in counts:
        out[row["slot"]] = np.log((n + 1) / (row["df"] + 1)) + 1
    return out


def embed_text(
    df: DataFrame, text: str, embedder: Embedder | None = None, out: str = "embedding"
) -> DataFrame:
    """Add a unit vector per text; null where the text has none."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model.load()
        for batch in batches:
            raw = np.asarray(model.embed(batch.fillna("").tolist()), dtype=float)
            norm = np.linalg.norm(raw, axis=1)
            unit = raw / np.where(norm > 0, norm, 1.0)[:, None]
            yield pd.Series([v if n > 0 else None for v, n in zip(unit, norm)], dtype=object)

    # Not to be run a second time by a filter on its result.
    return df.withColumn(out, vectors.asNondeterministic()(text))
