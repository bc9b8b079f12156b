"""BM25 search over chunk texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.bounds import fits_broadcast, measured_bytes
from lodgelens.functions.text import words
from lodgelens.operators.filters import asked_route, offered_routes, wanted_items
from lodgelens.operators.topk import top_items
from lodgelens.session import materialise

# Okapi parameters: common defaults, a choice of this package.
K1, B = 1.2, 0.75

#: Texts are wide; keep item blocks of the paired plan small.
TEXT_BLOCK, QUESTION_BLOCK = 2048, 4096
#: Queries scored by one dense block.
QUERY_SLICE = 256


class Bm25Score:
    """Okapi BM25 over distinct query words. Texts without a shared word do not qualify.

    Query weights stay sparse; a dense block holds ``QUERY_SLICE`` queries by their own
    words only, so memory does not grow with the vocabulary of all queries.
    """

    def __init__(self, average_length: float, k1: float = K1, b: float = B):
        self.average_length, self.k1, self.b = average_length, k1, b

    def prepare(self, queries: pd.DataFrame):
        lengths = queries["terms"].map(len).to_numpy()
        codes, vocabulary = pd.factorize(np.concatenate(queries["terms"].to_list()))
        weights = np.concatenate(queries["idfs"].to_list())
        start = np.concatenate([[0], np.cumsum(lengths)])
        return pd.Index(vocabulary), start, codes, weights

    def width(self, state) -> int:
        _, start, _, _ = state
        return int(max(np.diff(start), default=1)) * min(QUERY_SLICE, len(start) - 1)

    def _gains(self, vocabulary: pd.Index, lists: list) -> tuple[np.ndarray, ...]:
        """Item row, word code and saturated frequency of every known word."""
        length = np.array([len(w) for w in lists], dtype=float)
        row = np.repeat(np.arange(len(lists)), length.astype(int))
        code = vocabulary.get_indexer(np.concatenate(lists)) if len(row) else np.array([], int)
        known = code >= 0
        pair, tf = np.unique(row[known] * len(vocabulary) + code[known], return_counts=True)
        row, code = pair // len(vocabulary), pair % len(vocabulary)
        norm = self.k1 * (1 - self.b + self.b * length / self.average_length)
        return row, code, tf * (self.k1 + 1) / (tf + norm[row])

    def score(self, state, picked: np.ndarray, items: pd.DataFrame) -> np.ndarray:
        vocabulary, start, codes, weights = state
        row, code, gain = self._gains(vocabulary, items["words"].to_list())
        scores = np.zeros((len(picked), len(items)))
        for at in range(0, len(picked), QUERY_SLICE):
            part = picked[at : at + QUERY_SLICE]
            spans = [np.arange(start[q], start[q + 1]) for q in part]
            span = np.concatenate(spans)
            own, local = np.unique(codes[span], return_inverse=True)
            asked = np.zeros((len(part), len(own)))
            asked[np.repeat(np.arange(len(part)), [len(x) for x in spans]), local] = weights[span]
            place = np.full(len(vocabulary), -1)
            place[own] = np.arange(len(own))
            used = place[code] >= 0
            found = np.zeros((len(items), len(own)))
            found[row[used], place[code[used]]] = gain[used]
            scores[at : at + QUERY_SLICE] = asked @ found.T
        return np.where(scores > 0, scores, -np.inf)


def word_statistics(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(t, df, total_words)`` per word, in one pass over ``words`` arrays.

    The row of the empty word, which no text contains, counts all texts and their words.
    Words are de-duplicated per text and counted before the shuffle, so a word in every
    text costs one partial row per task. With a ``vocabulary`` only its words are counted.
    """
    marked = F.array_append(F.array_distinct("words"), F.lit(""))
    # The length first: a row per word must not carry the whole list along.
    sized = docs.select("words", F.size("words").alias("len"))
    found = sized.select(F.explode(marked).alias("t"), "len")
    if vocabulary is not None:
        wanted = vocabulary.select("t").union(docs.sparkSession.createDataFrame([("",)], "t string"))
        small = fits_broadcast(vocabulary)
        distinct = wanted.distinct()
        found = found.join(F.broadcast(distinct) if small else distinct, "t", "left_semi")
    total = F.sum(F.when(F.col("t") == "", F.col("len"))).alias("total_words")
    return found.groupBy("t").agg(F.count("*").alias("df"), total)


def lexical_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 20,
    statistics: DataFrame | None = None,
    filtered: bool = False,
    **plan,
) -> DataFrame:
    """``(query_id, rank, chunk_id, score)`` by BM25 over ``query`` and ``chunk_text``.

    Two passes over the texts: word statistics, then the scores. Stored ``statistics`` of
    the whole table (see :func:`word_statistics`) save the first one. With ``filtered``
    the queries' own filters apply ahead of the ranking; word statistics stay global. A null
    text is no text.
    """
    chunks = chunks.filter(F.col("chunk_text").isNotNull())
    split = words(F.col("chunk_text")).alias("words")
    docs = chunks.select(F.col("chunk_id").alias("item_id"), split)
    terms = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("t"))
    if statistics is None:
        statistics = materialise(word_statistics(docs, terms.select("t")), "word-statistics")
    corpus = statistics.filter("t = ''").select("df", "total_words").first()
    total = int(corpus["df"]) if corpus else 0
    average_length = max(float(corpus["total_words"] or 0), 1.0) / total if total else 1.0
    idf = F.log(1.0 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    packed = (
        terms.join(statistics, "t")
        .select("query_id", "t", idf.alias("idf"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("t", "idf"))).alias("pairs"))
        .select("query_id", F.col("pairs.t").alias("terms"), F.col("pairs.idf").alias("idfs"))
    )
    if filtered:
        routes = queries.select("query_id", asked_route().alias("route"))
        packed = packed.join(routes, "query_id")
        offered = chunks.select(
            F.col("chunk_id").alias("item_id"), "chunk_text", F.explode(offered_routes()).alias("route")
        )
        docs = wanted_items(offered, routes).select("item_id", "route", split)
    plan.setdefault("item_block", TEXT_BLOCK)
    plan.setdefault("query_block", QUESTION_BLOCK)
    # A packed query holds its terms and one weight each: no more than twice the terms.
    plan.setdefault("query_bytes", 2 * measured_bytes(terms))
    top = top_items(packed, docs, Bm25Score(average_length), k, **plan)
    return top.select("query_id", "rank", F.col("item_id").alias("chunk_id"), "score")
