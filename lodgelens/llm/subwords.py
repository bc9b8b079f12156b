"""Subword ids of whole texts, working on the distinct words of a slice.

The tokenizer's file is read for its merges, which are applied to all distinct words at once with numpy:
in every round each word joins its best pair. Words out of the usual (other scripts, control characters,
very long runs) go through the tokenizers library itself. Both give the same ids.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from lodgelens.llm.words import hash_strings, split_words

#: Words kept by one Python worker; those met later are tokenized again in each slice.
MAX_STORED_WORDS = 400_000
#: Bytes of the longest piece that the array form takes.
LONGEST_PIECE = 40
_JOINED = 200
_NONE = np.int32(2**31 - 1)
_SLOTS = 1 << 19
#: The tokenizer's own pattern for pieces of a word.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_UNUSUAL = regex.compile(r"[^ -~¡-ɏ]|<\|")


def default_tokenizer() -> str:
    """Path of the public tokenizer that is used unless another is given."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """Byte-pair merges of pieces whose last byte is marked as a word's end."""

    def __init__(self, model: dict):
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        names = _byte_names()
        self.inner = np.array([vocabulary[n] for n in names], np.int32)
        self.last = np.array([vocabulary[n + end] for n in names], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = np.int64(len(vocabulary))
        key = np.array([vocabulary[a] * len(vocabulary) + vocabulary[b] for a, b in pairs], np.int64)
        self.joined = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        # Hash tables with one key per slot; keys that meet another go to the next table.
        self.tables, left = [], np.arange(len(key))
        while len(left):
            place = self._slot(key[left], len(self.tables))
            names, first = np.unique(place, return_index=True)
            slots, ranks = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, _NONE, np.int32)
            slots[names], ranks[names] = key[left][first], left[first]
            self.tables.append((slots, ranks))
            left = np.delete(left, first)

    @staticmethod
    def _slot(key: np.ndarray, table: int) -> np.ndarray:
        factor = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[table % 3])
        return (key.astype(np.uint64) * factor >> np.uint64(45)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.base + right, -2)
        out = None
        for t, (slots, ranks) in enumerate(self.tables):
            place = self._slot(key, t)
            rank = np.where(slots[place] == key, ranks[place], _NONE)
            out = rank if out is None else np.minimum(out, rank)
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the count of each."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.zeros(len(pieces), np.int64)
        found, owner = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for low, high in ((0, 6), (6, 10), (10, 16), (16, max(17, int(size.max(initial=1))))):
            some = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                ids, n = self._encode([pieces[i] for i in part.tolist()], size[part])
                counts[part] = n
                found.append(ids)
                owner.append(np.repeat(part, n))
        order = np.argsort(np.concatenate(owner), kind="stable")
        return np.concatenate(found)[order], counts

    def _encode(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = int(size.max())
        data = np.frombuffer(b"".join([p.ljust(wide, b"\0") for p in pieces]), np.uint8).reshape(len(pieces), wide)
        ids = self.merged(data, size)
        return ids[ids >= 0].astype(np.uint32), (ids >= 0).sum(axis=1)

    def merged(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of pieces given as rows of bytes; -1 after the last."""
        n, wide = data.shape
        at = np.arange(wide)
        ids = np.where(at < size[:, None], self.inner[data], np.int32(-1))
        rows = np.arange(n)
        ids[rows, size - 1] = self.last[data[rows, size - 1]]
        if wide > 1:
            rank = self._ranks(ids[:, :-1], ids[:, 1:])
            live = rows
            while len(live):
                best = rank[live].argmin(axis=1)
                go = rank[live, best] != _NONE
                live, best = live[go], best[go]
                if not len(live):
                    break
                joined = self.joined[rank[live, best]]
                step = at[None, :] + (at[None, :] > best[:, None])
                padded = np.pad(ids[live], ((0, 0), (0, 1)), constant_values=-1)
                moved = np.take_along_axis(padded, step, axis=1)
                here = np.arange(len(live))
                moved[here, best] = joined
                ids[live] = moved
                places = np.pad(rank[live], ((0, 0), (0, 1)), constant_values=_NONE)
                shifted = np.take_along_axis(places, step[:, :-1], axis=1)
                shifted[here, np.minimum(best, wide - 2)] = _NONE
                right = best < wide - 1
                shifted[here[right], best[right]] = self._ranks(joined[right], moved[here[right], best[right] + 1])
                left = best > 0
                shifted[here[left], best[left] - 1] = self._ranks(moved[here[left], best[left] - 1], joined[left])
                rank[live] = shifted
        return ids


class WordEncoder:
    """Ids of words for a tokenizer whose pieces never cross white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            self.merges = Merges(json.load(file)["model"])
        self.keys = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.flat, self.start = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for group in groups:
            coded = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in group])
            owner = np.searchsorted(ends, [o[0] for o in coded.offsets], side="right")
            counts.append(np.bincount(owner.astype(np.int64), minlength=len(group)))
            ids.append(np.array(coded.ids, np.uint32))
        return np.concatenate(ids), np.concatenate(counts)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        usual: dict[str, int] = {}
        place, owner, odd = [], [], []
        joined = " ".join(words)
        checked = _UNUSUAL.search(joined) is None and unicodedata.is_normalized("NFC", joined)
        for i, word in enumerate(words):
            plain = word
            if not checked:
                plain = unicodedata.normalize("NFC", word)
                if _UNUSUAL.search(plain):
                    odd.append(i)
                    continue
            if len(plain) > LONGEST_PIECE // 2:
                odd.append(i)
                continue
            plain = plain.lower()
            if plain.isalpha():
                place.append(usual.setdefault(plain, len(usual)))
                owner.append(i)
                continue
            if plain[:-1].isalpha() and plain[-1] in ".,!?":
                pieces = plain[:-1], plain[-1]
            else:
                pieces = _PIECES.findall(plain)
            for piece in pieces:
                place.append(usual.setdefault(piece, len(usual)))
                owner.append(i)
        ids, counts = self.merges.encode([p.encode() for p in usual])
        first = np.cumsum(counts) - counts
        place, owner = np.array(place, np.int64), np.array(owner, np.int64)
        piece_ids = ids[runs(first[place], counts[place])]
        total = np.bincount(owner, weights=counts[place], minlength=len(words)).astype(np.int64)
        if not odd:
            return piece_ids, total
        more, sizes = self._by_library([words[i] for i in odd])
        own, extra = np.repeat(owner, counts[place]), np.repeat(np.array(odd, np.int64), sizes)
        order = np.argsort(np.concatenate([own, extra]), kind="stable")
        total[odd] = sizes
        return np.concatenate([piece_ids, more])[order], total

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct lower-cased words, one after another, and the count of each.

        Words of a-z and the Latin-1 letters, with a full stop or comma after them, stay in arrays.
        """
        words = words.cast(pa.large_string())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        size = np.diff(offsets)
        found, owner, plain = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], np.zeros(len(words), bool)
        for low, high in ((0, 6), (6, 9), (9, 13), (13, 20), (20, LONGEST_PIECE)):
            some = np.flatnonzero((size > low) & (size <= high))
            for first in range(0, len(some), 20_000):
                part = some[first : first + 20_000]
                wide = int(size[part].max())
                at = np.arange(wide)
                inside = at < size[part][:, None]
                x = np.where(inside, data[np.minimum(offsets[part][:, None] + at, len(data) - 1)], 0).astype(np.uint8)
                tail = x[np.arange(len(part)), size[part] - 1]
                stop = ((tail == 46) | (tail == 44)) & (size[part] > 1)
                stem = size[part] - stop
                before = np.pad(x, ((0, 0), (1, 0)))[:, :-1]
                second = before == 0xC3
                fits = ((x >= 97) & (x <= 122)) | (x == 0xC3) | (second & (x != 0x97) & (x != 0xB7))
                good = (fits | (at >= stem[:, None])).all(axis=1)
                plain[part[good]] = True
                x = np.where(second & (x <= 0x9E), x + 0x20, x).astype(np.uint8)
                ids = self.merges.merged(np.where(at < stem[:, None], x, 0)[good], stem[good])
                own, end = part[good], np.flatnonzero(stop[good])
                found += [ids[ids >= 0].astype(np.uint32), self.merges.last[tail[good][end]].astype(np.uint32)]
                owner += [np.repeat(own, (ids >= 0).sum(axis=1)), own[end]]
        rest = np.flatnonzero(~plain)
        if len(rest):
            ids, counts = self._one_by_one(words.take(pa.array(rest)).to_pylist())
            found.append(ids)
            owner.append(np.repeat(rest, counts))
        owners = np.concatenate(owner)
        order = np.argsort(owners, kind="stable")
        return np.concatenate(found)[order], np.bincount(owners, minlength=len(words))

    def rows(self, words: pa.Array) -> np.ndarray:
        """Where ``gather`` finds each of ``words`` (lower-cased), until the next call."""
        keys, first, place = np.unique(hash_strings(words), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        row = np.empty(len(keys), np.int64)
        row[known] = self.place[at[known]]
        new = np.flatnonzero(~known)
        kept = len(self.place)
        self.flat, self.start = self.flat[: self.start[kept]], self.start[: kept + 1]
        if len(new):
            ids, counts = self._encoded(words.take(pa.array(first[new])))
            self.flat = np.concatenate([self.flat, ids])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
            row[new] = np.arange(kept, kept + len(new))
            if kept + len(new) <= MAX_STORED_WORDS:
                self.keys = np.insert(self.keys, at[new], keys[new])
                self.place = np.insert(self.place, at[new], row[new])
        return row[place]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each document has."""
        words, doc = split_words(texts)
        per_doc = np.zeros(len(texts), np.int64)
        if not len(words):
            return np.empty(0, np.uint32), per_doc
        ids, count = self.gather(self.rows(words))
        return ids, np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)

    def gather(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these rows, one after another, and the count of each."""
        count = self.start[row + 1] - self.start[row]
        return self.flat[runs(self.start[row], count)], count


def runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] values), then those of the next entry, and so on."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total) + np.repeat(start - before, count)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and tokenizer, kept from task to task."""
    return WordEncoder(path)
