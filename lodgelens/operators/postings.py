"""A stored text index for BM25: postings in blocks with their largest impact.

``build_text_index`` writes three tables below a folder. ``postings`` has blocks of at most ``BLOCK``
postings of one term, best impact first; ``terms`` has each term's number of texts and largest impact;
``corpus`` has one row. A search reads only its own terms, and
of these only what can still lift a text among the ``k`` best:

1. Every query reads the first block of each of its terms. A text's impacts found there are a lower bound
   of its score, so the ``k``-th best of these sums is a score that the result's last row reaches: the
   query's floor.
2. A query's weakest terms, as many as together stay below the floor, cannot lift a text there: texts
   come from the blocks of the other terms. Of these, a block is skipped if its largest impact and the
   largest of all other terms stay below the floor.
3. The impacts found so far give a higher floor. Only texts that can reach it with the largest of the weak
   terms take part in the rest: their postings of weak terms are added. The rows are the same as without
   skipping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodgelens.functions.text import words
from lodgelens.operators.lexical import B, K1
from lodgelens.operators.ranking import top_per_key
from lodgelens.session import materialise

#: Postings of a block.
BLOCK = 128
#: Words of texts that are counted at once inside a task.
PIECE_WORDS = 1_000_000
#: Steps of an impact in the order of postings.
_IMPACTS = 1 << 20
#: Terms of a batch of queries that are handed to the scan as values; more are joined.
PUSHED_TERMS = 64
#: Scores are rounded to six places; a block is skipped only if it misses by more.
MARGIN = 2e-6


def _impact(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def build_text_index(chunks: DataFrame, path: str) -> None:
    """Index ``chunk_text`` by ``chunk_id`` below ``path``; the folders are overwritten. A null text is none.

    Texts are split once, and a text's words are counted where it is read; only where ids repeat do their
    texts meet in a shuffle. A word in every text is one posting per text, dealt over many tasks by range of
    one number of term, impact and text; blocks end at a range's edge, so no task holds a term's whole list.
    """
    repeated = chunks.groupBy("chunk_id").count().filter("count > 1").limit(1).count()
    chunks = chunks.filter(F.col("chunk_text").isNotNull())
    split = chunks.select("chunk_id", words(F.col("chunk_text")).alias("ws"))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    counted = split.mapInArrow(_counts, f"chunk_id {kind}, term string, tf long, length int")
    if repeated:
        counted = counted.groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    counted = materialise(counted, "postings")
    # Texts without words have no posting but count as texts.
    corpus = chunks.agg(F.count("*").alias("n")).first()["n"]
    total = counted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("w")).first()["w"]
    spark = chunks.sparkSession
    average = max(total, 1) / corpus if corpus else 1.0
    spark.createDataFrame([(corpus, float(average))], "n long, average double").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    scored = counted.select("term", "chunk_id", _impact(F.col("tf"), F.col("length"), average).alias("impact"))
    scored.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top")).write.mode("overwrite").parquet(f"{path}/terms")
    # One number orders postings by term, best impact first: it sorts without comparing strings.
    worst = F.floor((K1 + 1 - F.col("impact")) / (K1 + 1) * _IMPACTS).cast("long")
    place = F.shiftleft("code", 28) + F.greatest(F.lit(0), F.least(F.lit(_IMPACTS - 1), worst)) * 256 + F.pmod(F.hash("chunk_id"), F.lit(256))
    dealt = scored.select(_code().alias("code"), "term", "chunk_id", "impact").withColumn("place", place)
    dealt = dealt.repartitionByRange("place").sortWithinPartitions("place").drop("place")
    stored = dealt.mapInArrow(_blocks, f"code long, term string, top double, postings array<struct<impact:double,chunk_id:{kind}>>")
    stored.write.mode("overwrite").parquet(f"{path}/postings")


def _code() -> Column:
    """36 bits of a hash of ``term``, by which postings are ordered."""
    return F.shiftrightunsigned(F.xxhash64("term"), 28)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words (chunk_id, ws) with their number in it and its length."""
    for batch in batches:
        offsets = batch["ws"].offsets.to_numpy().astype(np.int64)
        words, offsets = batch["ws"].flatten(), offsets - offsets[0] if len(offsets) else offsets
        length = np.diff(offsets)
        piece = offsets[1:] // PIECE_WORDS
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            coded = words.slice(offsets[start], offsets[stop] - offsets[start]).dictionary_encode()
            wide = max(len(coded.dictionary), 1)
            row = np.repeat(np.arange(start, stop), length[start:stop])
            pairs, tf = np.unique(row * wide + coded.indices.to_numpy(), return_counts=True)
            row, code = pairs // wide, pairs % wide
            yield pa.record_batch(
                [batch["chunk_id"].take(pa.array(row)), coded.dictionary.take(pa.array(code)), pa.array(tf.astype(np.int64)), pa.array(length[row].astype(np.int32))],
                names=["chunk_id", "term", "tf", "length"],
            )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted postings (code, term, chunk_id, impact) of one range."""
    for batch in batches:
        if not batch.num_rows:
            continue
        # Terms of one code stand mixed, impacts only nearly in order.
        batch = batch.sort_by([("code", "ascending"), ("term", "ascending"), ("impact", "descending"), ("chunk_id", "ascending")])
        n = batch.num_rows
        term = batch["term"].dictionary_encode().indices.to_numpy()
        start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        within = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        first = np.flatnonzero(within % BLOCK == 0)
        pairs = pa.StructArray.from_arrays([batch["impact"], batch["chunk_id"]], ["impact", "chunk_id"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, n), pa.int32()), pairs)
        at = pa.array(first)
        yield pa.record_batch([batch["code"].take(at), batch["term"].take(at), batch["impact"].take(at), lists], names=["code", "term", "top", "postings"])


def _of_terms(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of ``df`` for the terms in ``terms``: by values in the scan while they are few."""
    few = terms.select("term", _code().alias("code")).distinct().limit(PUSHED_TERMS + 1).collect()
    if len(few) <= PUSHED_TERMS:
        if "code" in df.columns:  # stored in its order
            df = df.filter(F.col("code").isin([r["code"] for r in few]))
        return df.filter(F.col("term").isin([r["term"] for r in few]))
    return df.join(terms.select("term").distinct(), "term", "left_semi")


def weighed_terms(queries: DataFrame, path: str, k: int) -> DataFrame:
    """Per query and term: idf, most (the largest score it adds), all (their sum), floor, weak.

    ``floor`` is null where fewer than ``k`` texts were seen; then no term is weak.
    """
    spark: SparkSession = queries.sparkSession
    corpus = spark.read.parquet(f"{path}/corpus").first()
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))
    vocabulary = _of_terms(spark.read.parquet(f"{path}/terms"), asked)
    idf = F.log(1.0 + (F.lit(float(corpus["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = materialise(asked.join(vocabulary, "term").select("query_id", "term", "top", idf.alias("idf")), "terms")
    blocks = _of_terms(spark.read.parquet(f"{path}/postings"), known)
    seen = known.join(blocks, ["term", "top"]).select("query_id", "idf", F.explode("postings").alias("p"))
    sums = seen.groupBy("query_id", F.col("p.chunk_id").alias("chunk_id")).agg(F.sum(F.col("idf") * F.col("p.impact")).alias("least"))
    best = top_per_key(sums, ["query_id"], [F.desc("least")], k, tie="chunk_id").filter(F.col("rank") == k)
    floors = best.select("query_id", (F.col("least") - MARGIN).alias("floor"))
    most = F.col("idf") * F.col("top")
    ascending = Window.partitionBy("query_id").orderBy("most", "term")
    scaled = known.withColumn("most", most).join(floors, "query_id", "left")
    weak = F.coalesce(F.sum("most").over(ascending) < F.col("floor"), F.lit(False))
    whole = F.sum("most").over(Window.partitionBy("query_id"))
    return materialise(scaled.select("query_id", "term", "idf", "most", "floor", weak.alias("weak"), whole.alias("all")), "weighed")


def wanted_blocks(weighed: DataFrame, path: str) -> DataFrame:
    """Blocks from which texts come: query_id, term, idf, floor, postings."""
    strong = weighed.filter(~F.col("weak"))
    held = strong.join(_of_terms(weighed.sparkSession.read.parquet(f"{path}/postings"), strong), "term")
    reach = F.col("all") - F.col("most") + F.col("idf") * F.col("top")
    return held.filter(F.coalesce(reach >= F.col("floor"), F.lit(True))).select("query_id", "term", "idf", "floor", "postings")


def search_text_index(queries: DataFrame, path: str, k: int = 20) -> DataFrame:
    """``(query_id, rank, chunk_id, score)`` by BM25 for ``query``, from the index at ``path``."""
    spark = queries.sparkSession
    weighed = weighed_terms(queries, path, k)
    rows = wanted_blocks(weighed, path).select("query_id", "idf", F.explode("postings").alias("p"))
    part = rows.groupBy("query_id", F.col("p.chunk_id").alias("chunk_id")).agg(F.sum(F.col("idf") * F.col("p.impact")).alias("part"))
    part = materialise(part, "parts")
    # The k-th best of these sums is a better floor than that of the first blocks.
    best = top_per_key(part, ["query_id"], [F.desc("part")], k, tie="chunk_id").filter(F.col("rank") == k)
    floors = best.select("query_id", (F.col("part") - MARGIN).alias("floor"))
    rest = weighed.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("weak"), F.col("most"))), F.lit(0.0)).alias("rest"))
    able = F.coalesce(F.col("part") + F.col("rest") >= F.col("floor"), F.lit(True))
    reaching = part.join(rest.join(floors, "query_id", "left"), "query_id").filter(able).select("query_id", "chunk_id", "part")
    reaching = materialise(reaching, "reaching")
    weak = weighed.filter("weak")
    more = weak.join(_of_terms(spark.read.parquet(f"{path}/postings"), weak), "term").select("query_id", "idf", F.explode("postings").alias("p"))
    more = more.select("query_id", F.col("p.chunk_id").alias("chunk_id"), (F.col("idf") * F.col("p.impact")).alias("part"))
    more = more.join(reaching.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    scored = reaching.union(more).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score")).filter("score > 0")
    top = top_per_key(scored, ["query_id"], [F.desc("score")], k, tie="chunk_id")
    return top.select("query_id", "rank", "chunk_id", "score")
