"""Main text of pages: boilerplate is what a host's suffix array finds repeated across its pages.

1. A page is cut into blocks. Markup says which stand inside an article and which are chrome (menus,
   adverts, forms, ...). Outside the article a page gives a stream of tokens: words, and a token for the
   elements around each block.
2. The streams of a host are concatenated and their suffixes sorted, by doubling, to a depth of
   ``LONG`` tokens: neighbours that agree so far are a long substring, and those that come from
   ``PAGES`` or more different pages are boilerplate. A longer repeat is a chain of such substrings, so
   this depth decides the same tokens as the whole array. A large host is sorted in slices; the
   substrings of its slices are then added up by Spark.
3. Articles give streams too, and their suffixes are sorted in the same way: a substring that at least
   as many different articles of the host carry as pages outside their articles is a passage of its
   articles. Only the parts of articles that may hold a substring asked for are sorted.
4. Tokens covered by boilerplate and by no passage go; the runs that are left are kept.

What an article element holds is kept whole: passages that many articles share belong to each of them.
Pages with equal streams count as one, so copies do not make a text boilerplate, nor a passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.html_blocks import ARTICLE, CHROME, LOOSE, blocks
from lodgelens.llm.words import hash_strings, mix, release_memory, rolled
from lodgelens.session import materialise

#: Tokens of a long substring, and different pages that make it boilerplate.
LONG = 8
PAGES = 3
#: Tokens of a host that one task sorts.
SLICE_TOKENS = 500_000
#: Html read at once inside a task.
BATCH_BYTES = 8 * 1024 * 1024
#: Slots of the set that tells which parts of articles may hold a substring asked for.
SLOTS = 1 << 22

_PARSED = "page_id long, url string, host string, d1 long, e1 long, text string, loose boolean, tokens array<long>, places array<int>, parts array<string>, inside array<string>"


def host_of(url) -> F.Column:
    """After ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _digest(values: np.ndarray) -> int:
    place = mix(np.arange(1, len(values) + 1, dtype=np.uint64))
    return int(mix(np.array([np.sum(mix(values ^ place), dtype=np.uint64) + np.uint64(len(values))]))[0].view(np.int64))


def page_stream(found) -> tuple[np.ndarray, np.ndarray]:
    """Tokens outside the article, and for each the number of its loose block (else -1)."""
    texts, owner = [], []
    for i, block in enumerate(found):
        if block.part == ARTICLE:
            continue
        words = [f"<{block.place}>", *block.text.split(" ")]
        texts += words
        owner += [-1] + [i if block.part == LOOSE else -1] * (len(words) - 1)
    return hash_strings(pa.array(texts, pa.string())), np.array(owner, np.int32)


def article_stream(texts, places) -> np.ndarray:
    """Tokens of an article: its blocks' words, each block after a token for the elements around it."""
    words = [word for text, place in zip(texts, places, strict=True) for word in (f"<{place}>", *text.split(" "))]
    return hash_strings(pa.array(words, pa.string()))


def _parse(batches):
    """Rows of ``_PARSED``. Texts of pages with loose blocks wait for the suffix array."""

    def rows(batch):
        out = []
        for page, url, host, source in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "host", "html")), strict=True):
            found = [b for b in blocks(source or "")]
            tokens, owner = page_stream(found)
            loose = bool((owner >= 0).any())
            own = _digest(tokens)
            parts = None
            if loose:
                # A part per block: the article's whole, loose ones by their number, chrome as null.
                parts = [None if b.part == CHROME else b.text for b in found]
                places = owner
            else:
                places = None
            text = None if loose else "\n".join(b.text for b in found if b.part == ARTICLE)
            evidence = _digest(tokens[owner >= 0]) if loose else own
            inside = [b.place for b in found if b.part == ARTICLE]
            out.append((page, url, host, own, evidence, text, loose, tokens.view(np.int64), places, parts, inside))
        columns = list(zip(*out, strict=True))
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["page_id", "url", "host", "d1", "e1", "text", "loose", "tokens", "places", "parts", "inside"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch["html"]), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes + 1024) // BATCH_BYTES
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            yield rows(batch.slice(start, stop - start))
    release_memory()


def suffix_runs(tokens: np.ndarray, page: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` tokens, and the rank of each (equal: same tokens).

    ``tokens`` are pages one after another. Suffixes with fewer than ``depth`` tokens of their own page
    are left out. Ranks double their depth in each round, as when a whole suffix array is built.
    """
    n = len(tokens)
    if n < depth:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    known = 1
    while known < depth:
        step = min(known, depth - known)
        later = np.full(n, -1, np.int64)
        later[: n - step] = np.where(page[: n - step] == page[step:], rank[step:], -1)
        rank = np.unique(rank * (n + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
        known += step
    whole = np.flatnonzero(page[: n - depth + 1] == page[depth - 1 :])
    order = whole[np.argsort(rank[whole], kind="stable")]
    return order, rank[order]


def _windows(tokens: np.ndarray, page: np.ndarray) -> np.ndarray:
    """A hash of the first ``LONG`` tokens of every suffix that has as many on its page."""
    return rolled(tokens, page, LONG)[0].view(np.int64)


def _slice_repeats(table: pa.Table, least: int) -> pa.Table:
    """Long substrings of one slice of a host's streams: host, window, pages. A host's only slice leaves out those on fewer than ``least``."""
    lengths = np.diff(table["tokens"].combine_chunks().offsets.to_numpy())
    tokens = table["tokens"].combine_chunks().flatten().to_numpy().view(np.uint64)
    page = np.repeat(np.arange(len(lengths)), lengths)
    order, rank = suffix_runs(tokens, page, LONG)
    if not len(order):
        return pa.table({"host": pa.array([], pa.string()), "window": pa.array([], pa.int64()), "pages": pa.array([], pa.int64())})
    # Neighbours in the array with equal ranks are one substring; its different pages are counted.
    pairs = np.unique(np.stack([rank, page[order]]), axis=1)[0]
    pages = np.bincount(pairs, minlength=int(rank.max()) + 1)
    first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
    at = np.empty(len(tokens), np.int64)
    whole = np.sort(order)
    at[whole] = _windows(tokens, page)
    found, count = at[order[first]], pages[rank[first]]
    if table["slices"][0].as_py() == 1:
        found, count = found[count >= least], count[count >= least]
    return pa.table({"host": pa.array([table["host"][0].as_py()] * len(found), pa.string()), "window": pa.array(found), "pages": pa.array(count)})


def host_repeats(streams: DataFrame, least: int = PAGES) -> DataFrame:
    """host, window, pages: long substrings on ``least`` or more different pages of a host.

    ``streams`` (host, e1, tokens) may repeat; equal ``e1`` of a host is one page.
    """
    distinct = materialise(streams.dropDuplicates(["host", "e1"]), "streams")
    slices = F.ceil(F.sum(F.size("tokens")) / SLICE_TOKENS).cast("int").alias("slices")
    sized = distinct.join(distinct.groupBy("host").agg(slices).where("slices > 0"), "host")
    cut = sized.withColumn("slice", F.pmod(F.xxhash64("e1"), F.col("slices")))
    repeats = cut.groupBy("host", "slice").applyInArrow(lambda table: _slice_repeats(table, least), "host string, window long, pages long")
    return repeats.groupBy("host", "window").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= least)


def _slots(host: np.ndarray, window: np.ndarray, slots: int) -> np.ndarray:
    """Slots of hosts' substrings in the set; ``host`` is the hash of its name. Hosts have theirs with window 0."""
    return (mix(host ^ mix(window.view(np.uint64))) % np.uint64(slots)).astype(np.int64)


def article_streams(parsed: DataFrame, asked: DataFrame) -> DataFrame:
    """host, e1, tokens: articles' tokens under substrings whose slot is one of those ``asked`` for (host, window).

    ``e1`` is of the whole article. A token 0 stands between parts that are not neighbours.
    """
    slots = SLOTS

    def slots_of(batches):
        for batch in batches:
            if batch.num_rows:
                host, window = hash_strings(batch["host"]), batch["window"].to_numpy()
                found = [_slots(host, window, slots), _slots(host, np.zeros_like(window), slots)]
                yield pa.record_batch([pa.array(np.unique(np.concatenate(found)))], names=["slot"])

    marked = np.zeros(slots, bool)
    marked[asked.mapInArrow(slots_of, "slot long").distinct().toArrow()["slot"].to_numpy()] = True  # at most SLOTS rows
    held = parsed.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches):
        marked = np.unpackbits(held.value, count=slots).view(bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            hosts = hash_strings(batch["host"])
            some = np.flatnonzero(marked[_slots(hosts, np.zeros(len(hosts), np.int64), slots)])
            out = []
            for at, row in zip(some.tolist(), batch.take(pa.array(some)).to_pylist(), strict=True):
                if row["loose"]:
                    outside = set(row["places"])
                    texts = [text for i, text in enumerate(row["parts"]) if text is not None and i not in outside]
                else:
                    texts = row["text"].split("\n") if row["inside"] else []
                tokens = article_stream(texts, row["inside"])
                hit = marked[_slots(hosts[at], _windows(tokens, np.zeros(len(tokens), np.int64)), slots)]
                if hit.any():
                    under = np.convolve(hit, np.ones(LONG, np.int64)) > 0
                    last = under & ~np.append(under[1:], False)
                    kept = np.flatnonzero(under)
                    out.append((row["host"], _digest(tokens), np.insert(tokens[kept], np.flatnonzero(last[kept]) + 1, 0).view(np.int64)))
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.string(), pa.int64(), pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "e1", "tokens"])
        release_memory()

    rows = parsed.where(F.size("inside") > 0).select("host", "text", "loose", "places", "parts", "inside")
    return rows.mapInArrow(run, "host string, e1 long, tokens array<long>")


def _loose_windows(batches):
    """host, d1, window, pos: long substrings of pages that touch a loose block."""
    for batch in batches:
        for host, d1, tokens, places in zip(*(batch[c] for c in ("host", "d1", "tokens", "places")), strict=True):
            values = tokens.values.to_numpy().view(np.uint64)
            owner = places.values.to_numpy()
            window = _windows(values, np.zeros(len(values), np.int64))
            touched = np.convolve(owner >= 0, np.ones(LONG, np.int64), "valid") > 0 if len(values) >= LONG else np.empty(0, bool)
            at = np.flatnonzero(touched)
            if len(at):
                yield pa.record_batch(
                    [pa.array([host.as_py()] * len(at), pa.string()), pa.array([d1.as_py()] * len(at), pa.int64()), pa.array(window[at]), pa.array(at, pa.int32())],
                    names=["host", "d1", "window", "pos"],
                )


def _cut(batches):
    """Texts of pages with loose blocks, without the tokens under ``covers`` that are under no ``passages``."""

    def under(starts, size):
        covered = np.zeros(size + 1, np.int64)
        for at in starts or []:
            covered[at] += 1
            covered[at + LONG] -= 1
        return np.cumsum(covered)[:-1] > 0

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            owner = np.array(row["places"], np.int32)
            gone = under(row["covers"], len(owner)) & ~under(row["passages"], len(owner))
            lines = []
            for i, text in enumerate(row["parts"]):
                if text is None:
                    continue
                mine = owner == i
                if mine.any() and gone[mine].any():
                    kept = ~gone[mine]
                    text = " ".join(w for w, k in zip(text.split(" "), kept.tolist(), strict=True) if k)
                if text:
                    lines.append(text)
            out.append((row["page_id"], row["url"], "\n".join(lines)))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    ``pages`` needs page_id, url and html; others are ignored. Null and empty html give an empty text.
    A page without an article element is loose altogether: its text is what its host does not repeat, or
    repeats in as many articles as outside them.
    Hosts are taken from the url; pages with a null url or one without ``://`` share the empty host.
    Repeated rows get the same text each and count as one page. An empty table gives no rows. Runs
    Spark jobs when called.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    parsed = materialise(source.mapInArrow(_parse, _PARSED), "parsed")
    repeats = materialise(host_repeats(parsed.select("host", "e1", "tokens")), "repeats")
    loose = parsed.where("loose")
    asked = loose.select("host", "d1", "tokens", "places").dropDuplicates(["host", "d1"])
    windows = asked.mapInArrow(_loose_windows, "host string, d1 long, window long, pos int")
    windows = materialise(windows.join(repeats, ["host", "window"]), "windows")
    passages = host_repeats(article_streams(parsed, windows.select("host", "window").distinct()), 1)
    found = windows.join(passages.withColumnRenamed("pages", "articles"), ["host", "window"], "left")
    passage = F.when(F.col("articles") >= F.col("pages"), F.col("pos"))
    covers = found.groupBy("host", "d1").agg(F.collect_list("pos").alias("covers"), F.collect_list(passage).alias("passages"))
    waiting = loose.select("page_id", "url", "host", "d1", "places", "parts").join(covers, ["host", "d1"], "left")
    cut = waiting.select("page_id", "url", "places", "parts", "covers", "passages").mapInArrow(_cut, "page_id long, url string, text string")
    texts = parsed.where("NOT loose").select("page_id", "url", "text").union(cut)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
