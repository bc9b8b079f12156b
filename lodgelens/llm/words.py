"""Texts in bounded slices, their words and word hashes, on Arrow buffers inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once inside a task; one longer text makes a slice of its own.
SLICE_BYTES = 3 * 1024 * 1024
SLICE_ROWS = 8192

_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> _SHIFT)) * _MIX1
    x = (x ^ (x >> _SHIFT)) * _MIX2
    return x ^ (x >> _SHIFT)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PLACES = mix(np.arange(1001, 1065, dtype=np.uint64) * _ODD) | np.uint64(1)


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def release_memory() -> None:
    """Give memory that was freed back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``SLICE_BYTES`` of ``column`` and ``SLICE_ROWS`` rows."""
    try:
        yield from _slices(batches, column)
    finally:
        release_memory()


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes + SLICE_BYTES // SLICE_ROWS) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            # Copied: Arrow's ASCII kernels misread the buffers of a slice.
            yield batch.take(pa.array(np.arange(start, stop)))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and the document number of each.

    ASCII letters are lower-cased; words end at space, tab, line feed, vertical tab, form
    feed and carriage return only. A null text has no words.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words = parts.flatten()
    doc = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), doc[real.to_numpy(zero_copy_only=False)]


def distinct(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct words of a slice and the place of every word among them."""
    coded = words.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes, the same in every process."""
    n = len(values)
    values = values.cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
    length = np.diff(offsets)
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(length)
    if len(full):
        data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        place = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1] - offsets[0], length)
        factor = mix(np.arange(1, int(length.max()) + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
        terms = _BYTES[data] * factor[place]
        out[full] = np.add.reduceat(terms, (offsets[:-1] - offsets[0])[full])
    return mix(out + length.astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word and the document number of each."""
    words, doc = split_words(texts)
    return hash_strings(words), doc


def rolled(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` neighbouring words of a document, and its number."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, doc.dtype)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += hashes[i : i + n] * _PLACES[i]
    inside = doc[:n] == doc[width - 1 :]
    return mix(total[inside]), doc[:n][inside]


def sorted_sets(values: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, cut to 50 bits, ordered by owner and value.

    Owner and value share one 64-bit number, so that one plain sort does; there are at most 2^14
    owners in a slice.
    """
    if owners > 1 << 14:
        raise ValueError("slices hold at most 2^14 rows")
    packed = np.sort(owner.astype(np.uint64) << np.uint64(50) | values >> np.uint64(14))
    if len(packed):
        packed = packed[np.append(True, packed[1:] != packed[:-1])]
    return packed & np.uint64((1 << 50) - 1), (packed >> np.uint64(50)).astype(np.int64)


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 50-bit shingle hashes of each document, ordered by document and hash.

    A document with fewer words has its whole sequence as one shingle, one without words none.
    """
    hashes, doc = word_hashes(texts)
    found, owner = rolled(hashes, doc, width)
    counts = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.append(0, np.cumsum(counts))[short]
        extra = counts[short].astype(np.uint64)  # no short text equals a window of a longer one
        for i in range(width - 1):
            has = counts[short] > i
            extra[has] = mix(extra[has] + hashes[first[has] + i] * _PLACES[i])
        found, owner = np.concatenate([found, extra]), np.concatenate([owner, short])
    return sorted_sets(found, owner, len(texts))
