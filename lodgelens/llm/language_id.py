"""Language identification by rank-order profiles of character n-grams.

A language's profile is the ranked list of its most frequent n-grams (one to three characters, words
padded with a space) in training texts. A document's own ranked list is compared with each profile:
the out-of-place distance adds up how far each n-gram is from its place, and the longest distance
for one that the profile lacks. The nearest profile wins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.llm.words import slices
from lodgelens.session import materialise

#: Ranks kept of each profile and of each document.
PROFILE = 400
#: Training texts expected per language, by a hash bound (larger languages are sampled).
SAMPLE_PER_LANGUAGE = 500
#: Languages whose profiles are held at once; more are compared in several passes.
LANGUAGES_PER_PASS = 500
#: Characters counted at once.
CHUNK = 1 << 20
HELD_OUT = (3, 1)
HASHES = 1 << 31
UNKNOWN = "und"
_SPACE = np.uint64(32)


def id_remainder(modulus: int):
    """crc32 of the id's text; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((0 <= c < 0x110000 and not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the lower-cased text as numbers, and how often each occurs.

    Everything but letters counts as one space; n-grams with a space inside are left out.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, 32)
    points = points[letter | np.append(True, letter[:-1])]  # one space at a time
    points = np.concatenate([[32], points[1:] if len(points) and points[0] == 32 else points, [32]]).astype(np.uint64)
    codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for at in range(0, max(len(points) - 1, 1), CHUNK):
        p = points[at : at + CHUNK + 2]
        own = p[:CHUNK]
        single = own[own != _SPACE]
        a, b = p[: CHUNK][: len(p) - 1], p[1 : CHUNK + 1]
        pair = (a << np.uint64(21) | b)[(a != _SPACE) | (b != _SPACE)]
        x, y, z = p[:-2][:CHUNK], p[1:-1][:CHUNK], p[2:][:CHUNK]
        triple = (x << np.uint64(42) | y << np.uint64(21) | z)[y != _SPACE]
        more, times = np.unique(np.concatenate([single, pair, triple]), return_counts=True)
        if not len(codes):
            codes, counts = more, times
        else:
            both, place = np.unique(np.concatenate([codes, more]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, times])).astype(np.int64)
            codes = both
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in order; ties by number."""
    if len(codes) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:PROFILE]


def profiles(docs: DataFrame) -> list[dict[str, list[int]]]:
    """Ranked n-grams of each language in the training rows (text and lang not null), pass by pass.

    All languages are learned. A language with more training rows than ``SAMPLE_PER_LANGUAGE`` learns
    from the share of them below a hash bound (equal rows together), so that no window or list of rows
    is needed.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(id_remainder(HELD_OUT[0]) != HELD_OUT[1])
    place = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(HASHES))
    placed = rows.select("lang", "text", place.alias("_place"))
    # Of many equal rows all are below the bound or none: the least place is always taken.
    bound = F.greatest(F.lit(float(SAMPLE_PER_LANGUAGE * HASHES)) / F.count("*"), F.min("_place") + 1.0)
    # Stored, so that Spark knows how small the table of languages is before it plans the join.
    bounds = materialise(placed.groupBy("lang").agg(bound.alias("_bound")), "language-bounds")
    picked = placed.join(bounds, "lang").where("_place < _bound").select("lang", "text")

    def count(batches):
        for part in slices(batches):
            held: dict[str, list] = {}
            for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist(), strict=True):
                held.setdefault(lang, []).append(ngrams(text))
            for lang, found in held.items():
                codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                total = np.bincount(place, weights=np.concatenate([n for _, n in found])).astype(np.int64)
                yield pa.record_batch(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(total)], names=["lang", "gram", "n"]
                )

    grams = picked.mapInArrow(count, "lang string, gram long, n long")
    total = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= PROFILE)
    passes: list[dict[str, list[int]]] = []
    # One list of PROFILE numbers per language; languages are few whatever the size of the corpus.
    ranked_grams = F.transform(F.array_sort(F.collect_list(F.struct("_r", "gram"))), lambda x: x["gram"])
    for row in top.groupBy("lang").agg(ranked_grams.alias("grams")).orderBy("lang").toLocalIterator():
        if not passes or len(passes[-1]) >= LANGUAGES_PER_PASS:
            passes.append({})
        passes[-1][row["lang"]] = row["grams"]
    return passes


class Ranker:
    """Out-of-place distances to a set of profiles."""

    def __init__(self, known: dict[str, list[int]]):
        self.names = sorted(known)
        self.grams = np.unique(np.array([g for v in known.values() for g in v], np.int64).view(np.uint64))
        self.place = np.full((len(self.names), len(self.grams) + 1), -1, np.int32)
        for i, name in enumerate(self.names):
            at = np.searchsorted(self.grams, np.array(known[name], np.int64).view(np.uint64))
            self.place[i, at] = np.arange(len(known[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        """Nearest language (ties by name) and 1 - distance / longest distance; "und" without letters."""
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        grams = ranked(*ngrams(text))
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at = np.where(self.grams[at] == grams, at, len(self.grams))
        place = self.place[:, at]
        far = np.where(place < 0, PROFILE, np.minimum(np.abs(place - np.arange(len(grams))), PROFILE)).sum(axis=1)
        best = int(far.argmin())
        return self.names[best], float(1 - far[best] / (PROFILE * len(grams)))


def _judged(rows: DataFrame, known: list[dict[str, list[int]]]) -> DataFrame:
    """``rows`` (text and others) with the nearest language of all passes and its score; ties by name.

    A pass keeps what the passes before it found unless it has a nearer language.
    """
    columns = rows.columns
    rows = rows.withColumns({"_lang": F.lit(UNKNOWN), "_score": F.lit(-1.0)})
    for some in known:

        def run(batches, some=some):
            judge = Ranker(some).judge
            for part in slices(batches):
                before = zip(part["_lang"].to_pylist(), part["_score"].to_pylist(), strict=True)
                found = [judge(t) for t in part["text"].to_pylist()]
                # Scores of "und" are 0 in every pass; names rise from pass to pass.
                best = [new if new[1] > old[1] else old for old, new in zip(before, found, strict=True)]
                held = [part[c] for c in columns]
                held += [pa.array([x for x, _ in best], pa.string()), pa.array([x for _, x in best], pa.float64())]
                yield pa.record_batch(held, names=[*columns, "_lang", "_score"])

        rows = rows.mapInArrow(run, rows.schema)
    return rows.withColumn("_score", F.greatest("_score", F.lit(0.0)))


def identify(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score.

    Profiles come from the rows of ``training`` (default: ``docs``; doc_id, text, lang) whose id has not
    the held-out remainder; rows without an id count as an empty one there and are learned from as well.
    ``lang_pred`` is "und", with score 0, for null texts, texts without a letter and if no language was
    learned. Repeated rows give repeated results. Other columns are ignored. The profiles are counted
    when this is called.
    """
    known = profiles(docs if training is None else training)
    rows = docs.select("doc_id", "text", (id_remainder(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"))
    return _judged(rows, known).select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others, unchanged) whose language is known.

    Rows judged "und" go: null texts, texts without a letter, and all if nothing can be learned. A
    text is "und" in all passes or in none, so the first decides.
    """
    known = profiles(docs)

    def run(batches):
        judge = Ranker(known[0] if known else {}).judge
        for part in slices(batches):
            yield part.filter(pa.array([judge(t)[0] != UNKNOWN for t in part["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
