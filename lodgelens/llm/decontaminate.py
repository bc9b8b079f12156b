"""Benchmark passages in documents, found through templates.

Numbers, units and names become typed placeholders. Windows of template tokens of the benchmark are
looked up by hash in every document. A document leaks an item if it holds enough of the item's windows
and the placeholders agree: one benchmark value always stands for one document value, so a question
with other numbers or names is caught, but a chance likeness of templates is not. If all places
together do not agree, each occurrence of the item in the document is judged on its own, so that
several questions of one template do not hide each other.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.words import hash_strings, rolled, slices

WIDTH = 8
#: Share of an item's windows that a document must hold, and of consistent placeholders.
LEAST_SHARE, LEAST_CONSISTENT = 0.3, 0.8
#: Words that may be missing or added between two windows of one occurrence.
GAP = 8
#: Items of fewer template tokens leak into a text only word for word, or as a whole document.
LEAST_TOKENS = 4
#: Items of fewer words, which ordinary texts hold, only as a whole document.
LEAST_WORDS = 3
#: Benchmark items per broadcast; more items are searched in several passes.
ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 32 * 1024 * 1024

#: Units that follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "mg", "g", "kg",
    "gram", "grams", "oz", "lb", "lbs", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second",
    "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month",
    "months", "year", "years", "mph", "kmh", "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd",
    "eur", "gbp", "degrees", "watt", "watts", "volt", "volts",
)
_NUMBER = r"^[$€£]?[+-]?[0-9][0-9.,:/]*%?$"
_MEASURE = r"^[$€£]?[+-]?[0-9][0-9.,]*[a-z]+$"
_PUNCTUATION = "\"'`.,;:!?()[]{}<>*#&_~|\\/-–—“”‘’…"
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (11, 12, 13))


def template(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template token, own token and document number of every word, in order.

    A name is a capitalised word that does not open a sentence. Words of punctuation only go.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(texts)
    doc = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    coded = parts.flatten().dictionary_encode()
    names, place = coded.dictionary, coded.indices.to_numpy()
    if not len(names):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    bare = pc.utf8_trim(names, characters=_PUNCTUATION)
    low = pc.utf8_lower(bare)
    flag = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
    own = hash_strings(low)
    number = flag(pc.match_substring_regex(pc.utf8_trim(pc.utf8_lower(names), characters="\"'.,;:!?()[]{}<>"), _NUMBER))
    measure = flag(pc.match_substring_regex(low, _MEASURE))
    unit_end = pc.is_in(pc.replace_substring_regex(low, r"^[$€£]?[+-]?[0-9.,]+", ""), value_set=pa.array(UNITS, low.type))
    measure &= flag(unit_end)
    unit = flag(pc.is_in(low, value_set=pa.array(UNITS, low.type)))
    capital = flag(pc.match_substring_regex(bare, r"^\p{Lu}\p{Ll}+$"))
    ends = flag(pc.match_substring_regex(names, r"[.!?]$"))
    real = flag(pc.greater(pc.binary_length(bare), 0))
    opens = np.append(True, ends[place[:-1]] | (doc[1:] != doc[:-1]))
    kind = own[place]
    after_number = np.append(False, number[place[:-1]])
    kind = np.where(capital[place] & ~opens, _NAME, kind)
    kind = np.where(unit[place] & after_number, _UNIT, kind)
    kind = np.where(measure[place], _UNIT, np.where(number[place], _NUM, kind))
    keep = real[place] | number[place]
    return kind[keep], own[place][keep], doc[keep]


class Templates:
    """Windows of a set of benchmark items, and the search for them."""

    def __init__(self, ids: list[int], texts: list[str]):
        kind, own, doc = template(pa.array(texts, pa.string()))
        self.items = []
        rows: dict[int, list] = defaultdict(list)
        whole: dict[int, list[int]] = defaultdict(list)
        self.verbatim: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.need: list[int] = []
        for i, item in enumerate(ids):
            at = np.flatnonzero(doc == i)
            k, o = kind[at], own[at]
            self.items.append((item, k, o))
            n = len(k)
            width = min(WIDTH, n)
            self.need.append(max(1, int(np.ceil(LEAST_SHARE * (n - width + 1)))))
            if not n:
                continue
            found, _ = rolled(k, np.zeros(n, np.int64), width)
            if n < LEAST_TOKENS:
                whole[n].append(i)
            if LEAST_WORDS <= n < LEAST_TOKENS:
                self.verbatim[n][int(rolled(o, np.zeros(n, np.int64), n)[0][0])].append(i)
            for j, h in enumerate(found.tolist()):
                rows[width].append((h, i, j))
            # What comes before the item decides how its first word is read in a document.
            for first in {int(o[0]), int(_NAME), int(_UNIT)} - {int(k[0])}:
                other = np.append(np.uint64(first), k[1:width])
                rows[width].append((int(rolled(other, np.zeros(width, np.int64), width)[0][0]), i, 0))
        self.widths = {}
        for width, entries in rows.items():
            entries.sort()
            table = np.array([h for h, _, _ in entries], np.uint64)
            seen = np.zeros(1 << 16, bool)
            seen[(table >> np.uint64(48)).astype(np.int64)] = True
            self.widths[width] = (table, np.array([(i, j) for _, i, j in entries], np.int64), seen)
        self.short = {i for v in whole.values() for i in v}
        self.verbatim = {n: dict(v) for n, v in self.verbatim.items()}
        self.verbatim_hashes = {n: np.array(list(v), np.uint64) for n, v in self.verbatim.items()}

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, float]]:
        """(document number, item id, share of windows, share of consistent placeholders)."""
        kind, own, doc = template(texts)
        hits: dict[tuple[int, int], list] = defaultdict(list)
        start = np.searchsorted(doc, np.arange(len(texts) + 1))
        for width, (table, where, seen) in self.widths.items():
            if len(kind) < width:
                continue
            inside = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
            found, owner = rolled(kind, doc, width)
            maybe = np.flatnonzero(seen[(found >> np.uint64(48)).astype(np.int64)])
            low = np.searchsorted(table, found[maybe])
            high = np.searchsorted(table, found[maybe], side="right")
            for m, a, b in zip(maybe[high > low], low[high > low], high[high > low], strict=True):
                for i, j in where[a:b].tolist():
                    if i in self.short and start[owner[m] + 1] - start[owner[m]] != width:
                        continue
                    at, (_, item_kind, item_own) = inside[m], self.items[i]
                    if j == 0 and kind[at] != item_kind[0] and own[at] != item_own[0]:
                        continue  # read in another way, it must be the same word
                    hits[int(owner[m]), i].append((int(at), j, width))
        for width, verbatim in self.verbatim.items():
            if len(own) < width:
                continue
            inside = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
            found, owner = rolled(own, doc, width)
            for m in np.flatnonzero(np.isin(found, self.verbatim_hashes[width])):
                for i in verbatim[int(found[m])]:
                    hits[int(owner[m]), i].append((int(inside[m]), 0, width))
        out = []
        for (d, i), places in hits.items():
            item, item_kind, item_own = self.items[i]
            windows = {j for _, j, _ in places}
            if len(windows) < self.need[i]:
                continue
            count = len(item_kind) - min(WIDTH, len(item_kind)) + 1
            agree = self._consistency(own, item_kind, item_own, places)
            if agree >= LEAST_CONSISTENT:
                out.append((d, item, len(windows) / count, agree))
                continue
            best = None
            for chain in self._occurrences(places, len(item_kind)):
                if len(chain) < self.need[i] or not self._telling(own, item_kind, item_own, chain):
                    continue
                agree = self._consistency(own, item_kind, item_own, chain)
                if agree >= LEAST_CONSISTENT:
                    best = max(best or (0.0, 0.0), (len(chain) / count, agree))
            if best:
                out.append((d, item, *best))
        return out

    @staticmethod
    def _occurrences(places, n) -> list[list]:
        """Places grouped by occurrence: those of each straight line, and chains over near lines.

        On a line the difference of document and item position is one number, so every unbroken copy
        is on a line of its own. In a chain both positions rise and words may be missing or added;
        copies side by side lie at least ``n`` apart.
        """
        gap = min(GAP, n - 1)
        shifts = sorted((s for s in range(-gap, gap + 1) if s), key=abs)
        by_place: dict[int, list] = defaultdict(list)
        lines: dict[int, list] = defaultdict(list)
        for place in places:
            by_place[place[0]].append(place)
            lines[place[0] - place[1]].append(place)
        chains: list[list] = []
        open_at: dict[int, list] = {}
        for at in sorted(by_place):
            rest = []
            for place in by_place[at]:
                chain = open_at.get(at - place[1])
                if chain is None:
                    rest.append(place)
                else:
                    chain.append(place)
            for place in rest:
                line = at - place[1]
                for shift in shifts:
                    chain = open_at.get(line + shift)
                    if chain is not None and chain[-1][0] < at and chain[-1][1] < place[1]:
                        del open_at[line + shift]
                        chain.append(place)
                        break
                else:
                    chain = [place]
                    chains.append(chain)
                open_at[line] = chain
        return [*lines.values(), *chains]

    @staticmethod
    def _telling(own, item_kind, item_own, places) -> bool:
        """Whether the places hold a literal word, or else mostly the item's own values.

        A run of placeholders alone fits any table of numbers.
        """
        pairs = {(j + k, at + k) for at, j, width in places for k in range(width)}
        if any(item_kind[j] not in (_NUM, _UNIT, _NAME) for j, _ in pairs):
            return True
        return sum(item_own[j] == own[at] for j, at in pairs) >= LEAST_CONSISTENT * len(pairs)

    @staticmethod
    def _consistency(own, item_kind, item_own, places) -> float:
        """Share of matched placeholders whose value stands for the value it mostly stands for."""
        pairs = {(j + k, at + k) for at, j, width in places for k in range(width) if item_kind[j + k] in (_NUM, _UNIT, _NAME)}
        votes: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for j, at in pairs:
            votes[int(item_own[j])][int(own[at])] += 1
        total = sum(sum(v.values()) for v in votes.values())
        return sum(max(v.values()) for v in votes.values()) / total if total else 1.0


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item it holds: doc_id, item_id, window_share, consistency.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; null and empty texts match nothing.
    Items of three words leak where their words stand in a row, items of one or two words only if
    they are the whole document.
    Each row of ``docs`` is searched on its own, so rows with one id can give equal pairs, which are
    returned once (the largest shares). Other columns are ignored; empty tables give no rows. Items are
    read in passes of bounded size when this is called.
    """
    found = None
    for templates in _passes(_items(benchmark)):
        held = docs.sparkSession.sparkContext.broadcast(templates)

        def run(batches, held=held):
            for part in slices(batches):
                rows = held.value.search(part["text"])
                if not rows:
                    continue
                doc, item, share, agree = zip(*rows, strict=True)
                yield pa.record_batch(
                    [part["doc_id"].take(pa.array(doc)).cast(pa.int64()), pa.array(item, pa.int64()), pa.array(share), pa.array(agree)],
                    names=["doc_id", "item_id", "window_share", "consistency"],
                )

        one = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, window_share double, consistency double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, window_share double, consistency double")
    return found.groupBy("doc_id", "item_id").agg(F.max("window_share").alias("window_share"), F.max("consistency").alias("consistency"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text and any other columns, unchanged) that hold no item of ``benchmark``."""
    for templates in _passes(_items(benchmark)):
        held = docs.sparkSession.sparkContext.broadcast(templates)

        def run(batches, held=held):
            for part in slices(batches):
                clean = np.ones(len(part), bool)
                clean[[d for d, *_ in held.value.search(part["text"])]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()


def _passes(items: DataFrame):
    """Benchmark items in groups of bounded number and size, in order of id."""
    ids, texts, size = [], [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if ids and (len(ids) >= ITEMS_PER_PASS or size + len(row["text"]) > BYTES_PER_PASS):
            yield Templates(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
    if ids:
        yield Templates(ids, texts)
