"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled training texts: one of the segments (words and
their beginnings) that ordinary texts have most, one that ends with the segments that toxic
texts have far more often instead. Every window of a text is compressed with both. A window that takes fewer
bytes with the toxic dictionary resembles toxic text. How many bytes, in how many windows, goes
through a logistic curve fitted on other training texts, so that the score is a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.words import slices

#: Labelled texts of each class the dictionaries (three in four) and the curve are fitted on, at most.
SAMPLE_PER_CLASS = 2400
WINDOW = 48
LONGEST_WINDOW = 256
BASE_BYTES, TAIL_BYTES = 30_000, 2_000
#: A toxic segment is in this many times the share of texts, and in so many texts at least.
RATIO, LEAST_TEXTS = 30.0, 8
#: A telling beginning is made longer as long as this share of its texts has the longer form.
GROWTH = 0.6
THRESHOLD = 0.3
HELD_OUT = (4, 2)


def id_remainder(modulus: int):
    """crc32 of the id's text; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def windows(text: str) -> list[bytes]:
    """The lower-cased text in windows that end at a space; long runs without one are cut."""
    data = text.lower().encode()
    out, at, size = [], 0, len(data)
    while at < size:
        end = data.find(b" ", at + WINDOW, at + LONGEST_WINDOW)
        end = min(size, at + LONGEST_WINDOW) if end < 0 else end
        out.append(b" " + data[at:end] + b" ")
        at = end + (data[end : end + 1] == b" ")
    return out


def _segments(texts: list[str]) -> Counter:
    """In how many texts each word, and each beginning of a word, occurs."""
    found: Counter = Counter()
    for text in texts:
        words = set(text.lower().split())
        found.update({f" {w[:60]} " for w in words} | {f" {w[:k]}" for w in words for k in range(4, min(len(w), 8))})
    return found


def _content(ranked: list[str], limit: int) -> bytes:
    """The segments up to ``limit`` bytes, the best last, where a match costs least.

    A segment that a better one contains is left out.
    """
    kept, size, held = [], 0, b""
    for segment in ranked:
        data = segment.encode()
        if size + len(data) > limit:
            break
        if data not in held:
            kept.append(data)
            size += len(data)
            held += data
    return b"".join(reversed(kept))


def _grown(counts: dict[str, int]) -> list[str]:
    """Telling beginnings, each made longer while it stays about as common; the commonest first.

    What a longer form adds for few texts only would match ordinary words by chance.
    """
    longer: dict[str, list[str]] = {}
    for s in counts:
        for k in range(5, len(s)):
            longer.setdefault(s[:k], []).append(s)
    out = {}
    for root in (s for s in counts if not any(s[:k] in counts for k in range(5, len(s)))):
        stem = root
        while more := [s for s in longer.get(stem, []) if counts[s] >= GROWTH * counts[root]]:
            stem = max(more, key=lambda s: (counts[s], len(s), s))
        out[stem] = counts[root]
    return sorted(out, key=lambda s: (-out[s], s))


def _different(texts: list[str]) -> list[str]:
    """Texts without near copies of earlier ones, whose words would all look telling.

    A text is left out if it has three of another's eight smallest hashes of word triples.
    """
    seen: Counter = Counter()
    kept = []
    for text in texts:
        words = text.lower().split()
        least = sorted({zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))})[:8]
        if sum(h in seen for h in least) < min(3, len(least)):
            kept.append(text)
        seen.update(least)
    return kept


def dictionaries(ordinary: list[str], toxic: list[str]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""
    ordinary, toxic = _different(ordinary), _different(toxic)
    plain, bad = _segments(ordinary), _segments(toxic)
    common = sorted(plain, key=lambda s: (-plain[s] * len(s), s))
    share = {s: n / max(len(toxic), 1) / ((plain[s] + 0.5) / max(len(ordinary), 1)) for s, n in bad.items() if n >= LEAST_TEXTS}
    telling = _grown({s: bad[s] for s, r in share.items() if r >= RATIO})
    base, tail = _content(common, BASE_BYTES), _content(telling, TAIL_BYTES)
    # As long as the toxic end, so that what both share lies at the same distance.
    return base + b"\0" * len(tail), base + tail


class Distance:
    """Features of texts from the compressed sizes of their windows with two dictionaries."""

    def __init__(self, contents: tuple[bytes, bytes]):
        shape = zstandard.ZstdCompressionParameters(
            window_log=16, hash_log=15, chain_log=15, search_log=4, min_match=5, target_length=8,
            strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.codecs = []
        for content in contents:
            if len(content) < 8:
                self.codecs.append(zstandard.ZstdCompressor(compression_params=shape))
                continue
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=shape)
            self.codecs.append(zstandard.ZstdCompressor(dict_data=held, compression_params=shape))

    def gains(self, text: str) -> np.ndarray:
        """Bytes that each window saves with the toxic dictionary."""
        plain, toxic = (c.compress for c in self.codecs)
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], np.float64)

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 5))
        for i, text in enumerate(texts):
            gain = self.gains(text)
            if len(gain):
                gain -= np.median(gain)  # what the language does
                high = gain >= 3
                out[i] = (gain.max(), np.log1p(high.sum()), high.mean() * 10, gain.clip(1).mean() - 1, (gain >= 2).mean())
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features, and the weights (intercept first) of a logistic regression."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + keep, a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[tuple[bytes, bytes], tuple]:
    """Dictionaries and curve from training rows; their share of toxic texts sets the intercept."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(id_remainder(HELD_OUT[0]) != HELD_OUT[1])
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rank = F.xxhash64("doc_id")
    parts = [known.where(F.col("toxic") == c).orderBy(rank, "doc_id").limit(SAMPLE_PER_CLASS) for c in (0, 1)]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * SAMPLE_PER_CLASS ids
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(picked, "doc_id")
    rows = texts.orderBy(rank, "doc_id", "text").limit(2 * SAMPLE_PER_CLASS).collect()
    sets = {c: [r["text"] for r in rows if r["toxic"] == c] for c in (0, 1)}
    build = {c: [t for i, t in enumerate(v) if i % 4] for c, v in sets.items()}
    check = {c: [t for i, t in enumerate(v) if not i % 4] for c, v in sets.items()}
    contents = dictionaries(build[0], build[1])
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    if not check[0] or not check[1]:
        return contents, (np.zeros(5), np.ones(5), np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    x = Distance(contents).features(check[0] + check[1])
    y = np.repeat([0.0, 1.0], [len(check[0]), len(check[1])])
    mean, scale, w = fit_logistic(x, y)
    w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return contents, (mean, scale, w)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, max_gain.

    ``labels`` (doc_id, toxic) serves training only, and only rows whose id has not the held-out
    remainder. Null and empty texts have no windows and get the curve's value for no gain. Without
    labels of both classes every text gets the share of toxic labels. Repeated rows and null ids are
    scored like others (a null id counts as an empty text in the remainder). Other columns are
    ignored. The model is fitted when this is called.
    """
    contents, (mean, scale, w) = fit(docs, labels)

    def run(batches):
        distance = Distance(contents)
        for part in slices(batches):
            x = distance.features([t or "" for t in part["text"].to_pylist()])
            z = w[0] + (x - mean) / scale @ w[1:]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch(
                [part["doc_id"].cast(pa.int64()), part["held_out"], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(x[:, 0])],
                names=["doc_id", "held_out", "score", "predicted", "max_gain"],
            )

    rows = docs.select("doc_id", "text", (id_remainder(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, max_gain double")
