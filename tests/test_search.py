"""Search, matching, routing, prompts and their metrics against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodgelens.operators import (
    dense,
    evaluation,
    fusion,
    lexical,
    matching,
    postings,
    prompts,
    quantised,
    rerank,
    routing,
)
from lodgelens.operators.embedding import HashingEmbedder, WeightedEmbedder, embed_text, fit_rarity
from lodgelens.operators.topk import top_items
from lodgelens.plans.answering import CLARIFY, plan_answers

FOLDER = "/root/testdata/sf0.001"
# Plans of the paired form: nothing may be broadcast, blocks are small.
PAIRED = {"broadcast_bytes": 0, "query_block": 37, "item_block": 53}


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(
        F.col("vec_id").alias("chunk_id"),
        "embedding",
        # A third and more of all chunks share one listing and one place.
        F.when(F.col("label") < 4, 0).otherwise(F.col("label")).cast("long").alias("listing_id"),
        F.when(F.col("label") < 4, "hot").otherwise("cold").alias("neighbourhood"),
    )


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.withColumnRenamed("chunk_id", "query_id")


def brute(vectors, asked, k, allowed=lambda q, c: True):
    items = sorted(vectors.collect(), key=lambda r: r["chunk_id"])
    matrix = np.array([r["embedding"] for r in items], dtype=float)
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    out = set()
    for q in asked.collect():
        v = np.array(q["embedding"], dtype=float)
        scores = np.round(matrix @ (v / np.linalg.norm(v)), 6)
        rows = [(-s, r["chunk_id"]) for s, r in zip(scores, items) if allowed(q, r)]
        for rank, (_, chunk) in enumerate(sorted(rows)[:k], 1):
            out.add((q["query_id"], rank, chunk))
    return out


def ranked(hits):
    return {(r["query_id"], r["rank"], r["chunk_id"]) for r in hits.collect()}


@pytest.mark.parametrize("plan", [{}, PAIRED])
def test_knn_exact_both_plans(vectors, asked, plan):
    assert ranked(dense.knn_exact(asked, vectors, 7, **plan)) == brute(vectors, asked, 7)


@pytest.mark.parametrize("plan", [{}, PAIRED])
def test_knn_filtered_hot_route(vectors, asked, plan):
    third = F.col("query_id") % 3
    scoped = asked.select(
        "query_id",
        "embedding",
        F.when(third == 0, F.col("listing_id")).alias("listing_id"),
        F.when(third == 1, F.upper("neighbourhood")).alias("neighbourhood"),
    )

    def allowed(q, c):
        by_listing = q["listing_id"] is None or q["listing_id"] == c["listing_id"]
        place = q["neighbourhood"]
        return by_listing and (place is None or place.lower() == c["neighbourhood"])

    got = ranked(dense.knn_filtered(scoped, vectors, 5, **plan))
    assert got == brute(vectors, scoped, 5, allowed)


@pytest.mark.parametrize("plan", [{}, PAIRED])
def test_ties_go_to_the_lowest_id(spark, plan):
    chunks = spark.range(500).select(
        F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")
    )
    one = spark.range(1).select(F.col("id").alias("query_id"), F.array(F.lit(2.0), F.lit(4.0)).alias("embedding"))
    hits = dense.knn_exact(one, chunks, 6, **plan)
    assert sorted(r["chunk_id"] for r in hits.collect()) == list(range(6))
    assert {r["score"] for r in hits.collect()} == {1.0}


def test_fewer_items_than_k_and_no_items(spark, vectors, asked):
    few = vectors.filter("chunk_id < 3")
    assert dense.knn_exact(asked, few, 20).count() == asked.count() * 3
    assert dense.knn_exact(asked, vectors.filter("chunk_id < 0"), 20).count() == 0
    assert dense.knn_exact(asked.filter("query_id < 0"), vectors, 20).count() == 0


@pytest.mark.parametrize("plan", [{}, PAIRED])
def test_ann_recall(vectors, asked, plan):
    model = dense.fit_cells(vectors, 8)
    exact = {(q, c) for q, _, c in ranked(dense.knn_exact(asked, vectors, 10))}
    near = {(q, c) for q, _, c in ranked(dense.knn_ann(asked, vectors, model, 10, probes=4, **plan))}
    every = {(q, c) for q, _, c in ranked(dense.knn_ann(asked, vectors, model, 10, probes=8, **plan))}
    assert len(exact & near) / len(exact) > 0.6
    assert every == exact


@pytest.mark.parametrize("plan", [{}, PAIRED])
def test_bm25_against_plain_python(spark, plan):
    texts = ["the cat sat", "the dog", "the the the", "cat and dog and cat", "", "zebra"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, chunk_text string")
    queries = spark.createDataFrame(
        [(1, "The cat"), (2, "dog dog zebra"), (3, "unknown"), (4, "")], "query_id long, query string"
    )
    docs = [t.split() for t in texts]
    mean = sum(map(len, docs)) / len(docs)

    def score(query, doc):
        total = 0.0
        for w in set(query):
            df = sum(w in d for d in docs)
            tf = doc.count(w)
            if df and tf:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        return round(total, 6)

    want = {}
    for q, words in ((1, ["the", "cat"]), (2, ["dog", "zebra"])):
        scored = [(score(words, d), i) for i, d in enumerate(docs)]
        want[q] = sorted(((-s, i) for s, i in scored if s > 0))[:3]
    got = {}
    for r in lexical.lexical_topk(queries, chunks, 3, **plan).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
    assert got == want


def test_bm25_with_stored_statistics(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    queries = spark.read.parquet(f"{FOLDER}/benchmark.parquet").toDF("query_id", "query")
    from lodgelens.functions.text import words

    stored = lexical.word_statistics(chunks.select(words(F.col("chunk_text")).alias("words")))
    a = lexical.lexical_topk(queries, chunks, 5, statistics=stored).collect()
    b = lexical.lexical_topk(queries, chunks, 5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_hashing_embedder_units(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,), ("?!",)], "t string")
    got = [r["embedding"] for r in embed_text(df, "t", HashingEmbedder(16)).collect()]
    assert math.isclose(np.linalg.norm(got[0]), 1.0)
    assert got[1:] == [None, None, None]


def test_plug_in_models(spark):
    class Lengths:
        def load(self):
            self.ready = True

        def embed(self, texts):
            assert self.ready
            return np.array([[len(t), 1.0] for t in texts])

        def score(self, queries, texts):
            assert self.ready
            return np.array([float(len(t)) for t in texts])

    df = spark.createDataFrame([("abc",)], "t string")
    assert len(embed_text(df, "t", Lengths()).first()["embedding"]) == 2
    pairs = spark.createDataFrame(
        [(1, 1, "a", "x"), (1, 2, "b", "xxx"), (1, 3, "c", "xx")],
        "query_id long, rank int, chunk_id string, chunk_text string",
    ).withColumn("query", F.lit("q"))
    best = rerank.rerank_topk(pairs, 2, Lengths()).orderBy("rerank_rank").collect()
    assert [r["chunk_id"] for r in best] == ["b", "c"]


def test_rerank_ties_keep_rank_order(spark):
    pairs = spark.createDataFrame(
        [(1, 2, "a", "same"), (1, 1, "b", "same"), (1, 3, "c", "other")],
        "query_id long, rank int, chunk_id string, chunk_text string",
    ).withColumn("query", F.lit("same"))
    best = rerank.rerank_topk(pairs, 3).orderBy("rerank_rank").collect()
    assert [(r["chunk_id"], r["rerank_score"]) for r in best] == [("b", 1.0), ("a", 1.0), ("c", 0.0)]


def test_fusion_of_two_lists(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, chunk_id string, rank int")
    two = spark.createDataFrame([(1, "b", 1), (2, "c", 1)], "query_id long, chunk_id string, rank int")
    fused = fusion.reciprocal_rank_fusion(one, two).collect()
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in fused}
    assert got[(1, 1)] == ("b", round(1 / 62 + 1 / 61, 8))
    assert got[(1, 2)] == ("a", round(1 / 61, 8)) and got[(2, 1)][0] == "c"


def test_ir_metrics_edges(spark):
    hits = spark.createDataFrame(
        [
            ("q1", 1, "10.0"), ("q1", 2, "10"), ("q1", 3, "11"),
            ("q2", 1, "99"), ("q2", 2, "20"),
            ("q4", 1, "1"),
        ],
        "query_id string, rank int, listing_id string",
    )
    qrels = spark.createDataFrame(
        [("q1", "10"), ("q1", "11"), ("q2", "20"), ("q3", "30")], "query_id string, listing_id string"
    )
    per_query = evaluation.ir_metrics(hits, qrels, (1, 3))
    got = {r["query_id"]: r for r in per_query.collect()}
    assert set(got) == {"q1", "q2", "q3"}
    assert got["q1"]["mrr"] == 1.0 and got["q2"]["mrr"] == 0.5 and got["q3"]["mrr"] == 0.0
    assert got["q1"]["recall_1"] == 0.5 and got["q1"]["recall_3"] == 1.0
    ideal = 1 + 1 / math.log2(3)
    assert math.isclose(got["q1"]["ndcg_chunk_3"], (ideal + 0.5) / ideal)
    assert math.isclose(got["q1"]["ndcg_listing_3"], 1.0)
    assert math.isclose(got["q2"]["ndcg_chunk_3"], 1 / math.log2(3))
    mean = evaluation.macro_mean(per_query).first()
    assert mean["n_queries"] == 3 and mean["mrr"] == 0.5
    empty = evaluation.macro_mean(per_query.filter("false")).first()
    assert empty["n_queries"] == 0 and empty["mrr"] == 0.0


def test_judge_summary(spark):
    raw = [('{"faithfulness": 5, "relevance": 4}',), ('{"relevance": 5}',), ("nothing",), (None,)]
    got = evaluation.judge_summary(spark.createDataFrame(raw, "raw string")).first()
    assert tuple(got) == (5.0, 4.5, 4)


PLACES = ["I Centro Storico", "IX Eur", "X Ostia/Acilia", "XI Ostia/Nord"]
NAMES = [(1, "Casa Roma"), (2, "Santini Home"), (3, "The Santini Home Suite"), (9, "Santini Home Suite")]


@pytest.fixture(scope="module")
def known(spark):
    places = spark.createDataFrame([(p,) for p in PLACES], "place_name string")
    listings = spark.createDataFrame(NAMES, "listing_id long, listing_name string")
    return places, listings


@pytest.mark.parametrize(
    "said, place",
    [
        ("com'è OSTIA?", "X Ostia/Acilia"),
        ("una casa all'eur", "IX Eur"),
        ("in centro o a ostia", "I Centro Storico"),
        ("nel nord", "XI Ostia/Nord"),
        ("x i ix", None),
        ("europa", None),
    ],
)
def test_place_match(spark, known, said, place):
    asked = spark.createDataFrame([(1, said)], "id long, t string")
    got = matching.match_places(asked, known[0], "id", "t", "place_name").collect()
    assert [r["place"] for r in got] == ([place] if place else [])


@pytest.mark.parametrize(
    "said, listing",
    [
        ("cosa dicono di santini home?", 2),
        ("parlami di Santini Home Suite", 3),
        ("la casa roma", None),
        ("santinihome", None),
        ("the santini, home", 3),
    ],
)
def test_name_match(spark, known, said, listing):
    asked = spark.createDataFrame([(1, said)], "id long, t string")
    got = matching.match_listings(asked, known[1], "id", "t", "listing_id", "listing_name").collect()
    assert [r["listing_id"] for r in got] == ([listing] if listing else [])


SCOPE = "struct<kind: string, listing_id: bigint, neighbourhood: string, label: string>"


def test_routes_and_answers(spark, known):
    places, listings = known
    asked = spark.createDataFrame(
        [
            (1, "com'è pulito?", "rag", ("listing", 2, None, "Santini Home")),
            (2, "com'è pulito?", "rag", ("neighbourhood", None, " IX EUR", None)),
            (3, "rumore a ostia?", "rag", None),
            (4, "opinioni su Santini Home", "rag", None),
            (5, "rumore?", "rag", None),
            (6, "prezzo medio", "analytics", None),
            (7, "ciao", "conversational", None),
            (8, "ciao", "conversational", ("listing", 77, None, "Gone")),
            (9, "prezzo medio", "analytics", ("listing", 2, None, "Santini Home")),
            (10, "com'è?", "rag", ("neighbourhood", None, "", None)),
        ],
        f"question_id long, text string, intent string, scope {SCOPE}",
    )
    routed = routing.resolve_scopes(asked, places, listings).collect()
    got = {r["question_id"]: (r["route"], r["listing_id"], r["neighbourhood"]) for r in routed}
    assert got == {
        1: ("listing", 2, None),
        2: ("place", None, " IX EUR"),
        3: ("place", None, "X Ostia/Acilia"),
        4: ("listing", 2, None),
        5: ("clarify", None, None),
        6: ("analytics", None, None),
        7: ("conversational", None, None),
        8: ("listing", 77, None),
        9: ("analytics", None, None),
        10: ("clarify", None, ""),
    }
    chunks = spark.createDataFrame(
        [(f"c{i}", 2, "ix eur", "Entire", f"testo pulito numero {i}") for i in range(12)]
        + [("d", 3, "x ostia/acilia", None, "rumore di mare")],
        "chunk_id string, listing_id long, neighbourhood string, room_type string, chunk_text string",
    )
    answers = {r["question_id"]: r for r in plan_answers(asked, places, listings, chunks).collect()}
    assert answers[1]["n_contexts"] == 3 and "«Santini Home»" in answers[1]["prompt"]
    assert answers[2]["n_contexts"] == 8
    assert "[x ostia/acilia / ?]\nrumore di mare" in answers[3]["prompt"]
    assert answers[5]["reply"] == CLARIFY and answers[5]["prompt"] is None
    assert answers[8]["reply"] == "Non ci sono recensioni disponibili per «Gone»."
    assert answers[6]["prompt"] is None and answers[6]["reply"] is None
    one, two, clarify, gone = (answers[i] for i in (1, 2, 5, 8))
    assert one["instruction"] == prompts.INSTRUCTIONS["listing"] and one["listing_name"] == "Santini Home"
    assert two["instruction"] == prompts.INSTRUCTIONS["place"] and two["neighbourhood"] == " IX EUR"
    assert [c["rank"] for c in two["contexts"]] == list(range(1, 9)) and two["contexts"][0]["neighbourhood"] == "ix eur"
    assert all(c["text"] in two["prompt"] for c in two["contexts"]) and one["places"] is None
    assert clarify["places"] == sorted(r["place_name"] for r in places.distinct().collect())
    assert clarify["instruction"] is None and clarify["contexts"] == [] and gone["contexts"] == [] and gone["instruction"] is None
    assert answers[6]["instruction"] == prompts.INSTRUCTIONS["analytics"]


def test_prompt_without_hits(spark):
    queries = spark.createDataFrame([(1, "perché?")], "query_id long, query string")
    none = spark.createDataFrame(
        [], "query_id long, rerank_rank int, neighbourhood string, room_type string, chunk_text string"
    )
    row = prompts.assemble_prompts(queries, none).first()
    assert row["n_contexts"] == 0
    assert row["prompt"] == (
        "Contesto (recensioni recuperate):\n\n(nessun contesto recuperato)\n\n"
        "Domanda: perché?\n\nRisposta grounded sul contesto:"
    )


def test_route_columns_must_match(spark):
    class Ones:
        def prepare(self, queries):
            return None

        def width(self, state):
            return 1

        def score(self, state, picked, items):
            return np.ones((len(picked), len(items)))

    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, route string")
    items = spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "b")], "item_id string, route string")
    for plan in ({}, PAIRED):
        got = top_items(queries, items, Ones(), 5, **plan).collect()
        assert sorted((r["query_id"], r["item_id"]) for r in got) == [(1, "x"), (1, "y"), (2, "z")]


def test_cell_index_prunes_folders(spark, vectors, asked, tmp_path):
    model = dense.fit_cells(vectors, 8)
    stored = dense.write_cell_index(vectors, model, str(tmp_path / "cells"))
    few = asked.filter("query_id < 2")
    hits = dense.knn_ann(few, stored, model, 10, probes=2)
    assert "dynamicpruning" in hits._jdf.queryExecution().executedPlan().toString()
    assert ranked(hits) == ranked(dense.knn_ann(few, vectors, model, 10, probes=2))


@pytest.mark.parametrize("mode", ["dense", "lexical", "hybrid"])
def test_known_item_evaluation(spark, tmp_path, mode):
    """A query made of a text's own words must find its listing."""
    from lodgelens.plans.evaluation import evaluate_retrieval
    from lodgelens.sources.query_sets import write_query_set

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    chunks = docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("listing_id"), F.col("text").alias("chunk_text")
    )
    labelled = docs.filter("n_chars > 500").select(
        F.concat(F.lit("q"), "doc_id").alias("id"),
        F.col("text").alias("query"),
        F.array(F.concat(F.col("doc_id").cast("string"), F.lit(".0"))).alias("relevant_listing_ids"),
    )
    path = str(tmp_path / "set")
    write_query_set(labelled, path, rows_per_file=20)
    per_query, mean = evaluate_retrieval(spark, path, chunks, mode)
    got = mean.first()
    # Copies of a text tie with it, so the first place is not always its own.
    assert got["n_queries"] == labelled.count() == per_query.count()
    assert got["recall_10"] > 0.95 and got["mrr"] > 0.8


def test_audited_sql(spark):
    from lodgelens.plans.analytics import UnsafeStatement, preview_audited, run_audited

    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    got = run_audited(spark, "```sql\nSELECT count(*) AS n FROM listings_t;\n```", listings_t=part)
    assert got.first()["n"] == part.count()
    for bad in ("drop table listings_t", "select 1; select 2", ""):
        with pytest.raises(UnsafeStatement):
            run_audited(spark, bad, listings_t=part)
    text = preview_audited(
        spark, "select p_partkey, p_brand from listings_t", [F.asc("p_partkey")], listings_t=part
    ).first()
    assert text["row_count"] == part.count()
    assert len(text["preview"].split("\n")) == 22
    none = preview_audited(
        spark, "select p_partkey from listings_t where p_partkey < 0", [F.asc("p_partkey")], listings_t=part
    ).first()
    assert tuple(none) == ("(nessuna riga)", 0)


def test_bm25_query_slices(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    queries = spark.read.parquet(f"{FOLDER}/benchmark.parquet").toDF("query_id", "query")
    whole = sorted(map(tuple, lexical.lexical_topk(queries, chunks, 5).collect()))
    monkeypatch.setattr(lexical, "QUERY_SLICE", 7)
    assert sorted(map(tuple, lexical.lexical_topk(queries, chunks, 5).collect())) == whole


def test_filtered_ann_probing_all_cells_is_exact(spark, vectors, asked):
    third = F.col("query_id") % 3
    scoped = asked.select(
        "query_id",
        "embedding",
        F.when(third == 0, F.col("listing_id")).alias("listing_id"),
        F.when(third == 1, F.col("neighbourhood")).alias("neighbourhood"),
    )
    model = dense.fit_cells(vectors, 6)
    near = dense.knn_ann(scoped, vectors, model, 5, probes=6, filtered=True)
    assert ranked(near) == ranked(dense.knn_filtered(scoped, vectors, 5))


def test_filtered_words_rank_inside_the_filter(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    chunks = docs.select(
        F.col("doc_id").alias("chunk_id"),
        (F.col("doc_id") % 4).alias("listing_id"),
        F.col("lang").alias("neighbourhood"),
        F.col("text").alias("chunk_text"),
    )
    queries = spark.read.parquet(f"{FOLDER}/benchmark.parquet").toDF("query_id", "query")
    scoped = queries.withColumns(
        {
            "listing_id": F.when(F.col("query_id") % 2 == 0, F.lit(1).cast("long")),
            "neighbourhood": F.when(F.col("query_id") % 3 == 0, F.lit("en")),
        }
    )
    everything = lexical.lexical_topk(queries, chunks, chunks.count())
    both = everything.drop("rank").join(chunks.drop("chunk_text"), "chunk_id").join(
        scoped.select("query_id", F.col("listing_id").alias("l"), F.col("neighbourhood").alias("p")), "query_id"
    )
    allowed = both.filter("(l is null or l = listing_id) and (p is null or p = neighbourhood)")
    want = evaluation.rank_hits(allowed, [F.desc("score"), F.asc("chunk_id")]).filter("rank <= 5")
    for plan in ({}, PAIRED):
        assert ranked(lexical.lexical_topk(scoped, chunks, 5, filtered=True, **plan)) == ranked(want)


@pytest.mark.parametrize("mode", ["dense", "lexical", "hybrid", "cells"])
def test_retrieval_modes_keep_to_the_scope(spark, mode):
    from lodgelens.plans.answering import retrieve_then_rerank

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    chunks = docs.select(
        F.col("doc_id").alias("chunk_id"),
        (F.col("doc_id") % 4).alias("listing_id"),
        F.col("lang").alias("neighbourhood"),
        F.col("source").alias("room_type"),
        F.col("text").alias("chunk_text"),
    )
    queries = spark.read.parquet(f"{FOLDER}/benchmark.parquet").toDF("query_id", "query")
    asked = queries.withColumns(
        {
            "listing_id": F.when(F.col("query_id") % 2 == 0, F.lit(1).cast("long")),
            "neighbourhood": F.when(F.col("query_id") % 2 == 1, F.lit(" EN")),
        }
    )
    how = {"mode": mode}
    if mode == "cells":
        chunks = embed_text(chunks, "chunk_text")
        how = {"cells": dense.fit_cells(chunks, 4)}
    best = retrieve_then_rerank(asked, chunks, **how).collect()
    assert best
    for r in best:
        assert r["listing_id"] == 1 if r["query_id"] % 2 == 0 else r["neighbourhood"] == "en"
        assert r["rerank_rank"] <= (3 if r["query_id"] % 2 == 0 else 8)


@pytest.mark.parametrize("plan", [{}, PAIRED])
def test_quantised_search(spark, vectors, asked, tmp_path, plan):
    model = quantised.fit_quantiser(vectors)
    assert model.books.shape == (32, quantised.ENTRIES, quantised.PART) and model.cells >= 4
    stored = quantised.write_index(vectors, model, str(tmp_path / "index"))
    again, same = quantised.read_index(spark, str(tmp_path / "index"))
    assert np.array_equal(same.books, model.books) and same.probes == model.probes
    exact = {(q, c) for q, _, c in ranked(dense.knn_exact(asked, vectors, 10))}
    hits = ranked(quantised.knn_quantised(asked, again, same, 10, **plan))
    assert len(exact & {(q, c) for q, _, c in hits}) >= 0.9 * len(exact)
    assert hits == ranked(quantised.knn_quantised(asked, stored, model, 10))
    # Every cell and a short list of everything: nothing is left to chance.
    whole = quantised.knn_quantised(asked, stored, model, 10, probes=model.cells, shortlist=vectors.count())
    assert ranked(whole) == brute(vectors, asked, 10)


def test_quantised_cells_of_clustered_vectors(spark, monkeypatch):
    """Few probes do for vectors in clusters, one of which holds a third of all; odd vectors are no harm."""
    monkeypatch.setattr(quantised, "ROWS_PER_CELL", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 7))
    rows = [(int(i), (centres[0 if i % 3 == 0 else i % 40] + 0.05 * rng.normal(size=7)).tolist()) for i in range(1200)]
    table = spark.createDataFrame(rows + [(5000, None), (5001, [0.0] * 7)], "chunk_id long, embedding array<double>")
    model = quantised.fit_quantiser(table)
    index = quantised.with_codes(table, model)
    few = table.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = {(q, c) for q, _, c in ranked(dense.knn_exact(few, table, 10))}
    hits = quantised.knn_quantised(few, index, model, 10)
    assert len(exact & {(q, c) for q, _, c in ranked(hits)}) >= 0.9 * len(exact)
    assert model.probes < model.cells / 3
    with pytest.raises(ValueError):
        quantised.fit_quantiser(table.filter("embedding IS NULL"))


@pytest.mark.parametrize("pushed", [0, 10_000])
def test_text_index_gives_the_same_rows(spark, monkeypatch, tmp_path, pushed):
    """Whatever is skipped: common words, ties, texts without words, null questions, few texts."""
    monkeypatch.setattr(postings, "PUSHED_TERMS", pushed)
    monkeypatch.setattr(postings, "BLOCK", 4)
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]
    share = np.array([1 / (i + 1) for i in range(60)])
    texts = [" ".join(rng.choice(vocabulary, int(n), p=share / share.sum())) for n in rng.integers(1, 40, 400)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:30], "", None, "w0 " * 5000])]
    chunks = spark.createDataFrame(rows, "chunk_id long, chunk_text string").repartition(4)
    asks = [(i, " ".join(rng.choice(vocabulary, 6))) for i in range(25)] + [(90, None), (91, ""), (92, "unheard words"), (93, "w0")]
    queries = spark.createDataFrame(asks, "query_id long, query string")
    postings.build_text_index(chunks, str(tmp_path / "index"))
    for k in (1, 5, 500):
        want = lexical.lexical_topk(queries, chunks, k).collect()
        found = postings.search_text_index(queries, str(tmp_path / "index"), k).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, want))
    weighed = postings.weighed_terms(queries, str(tmp_path / "index"), 3)
    assert weighed.filter("weak").count() > 0
    one = queries.filter("query_id = 93")
    read = postings.wanted_blocks(postings.weighed_terms(one, str(tmp_path / "index"), 3), str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert {r["term"] for r in read.select("term").distinct().collect()} == {"w0"}
    assert 0 < read.count() < stored.filter("term = 'w0'").count()


def test_text_index_of_nothing(spark, tmp_path):
    chunks = spark.createDataFrame([], "chunk_id long, chunk_text string")
    postings.build_text_index(chunks, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert postings.search_text_index(asked, str(tmp_path / "index")).count() == 0


def test_rare_words_weigh_more(spark):
    texts = [("la casa bella",), ("la casa pulita casa",), ("la stanza",), (None,), ("",)]
    df = spark.createDataFrame(texts, "t string")
    rarity = fit_rarity(df, "t", slots=1 << 12)
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (1 << 12)
    held = {"la": 3, "casa": 2, "bella": 1, "pulita": 1, "stanza": 1}
    assert len({slot(w) for w in held}) == len(held)
    for word, n in held.items():
        assert np.isclose(rarity[slot(word)], np.log(5 / (n + 1)) + 1)  # the empty text counts, the null one does not
    assert np.isclose(rarity[slot("unseen")], np.log(5) + 1)
    got = [r["embedding"] for r in embed_text(df, "t", WeightedEmbedder(rarity, 512)).collect()]
    assert got[3:] == [None, None] and all(np.isclose(np.linalg.norm(v), 1) for v in got[:3])
    bare = [r["embedding"] for r in embed_text(df, "t", HashingEmbedder(512)).collect()]
    assert np.dot(got[0], got[2]) < np.dot(bare[0], bare[2])
    assert (fit_rarity(df.limit(0), "t", slots=8) == 1).all()


def test_weighted_vectors_find_more(spark):
    from lodgelens.catalog.known_items import known_item_means

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    weighted = WeightedEmbedder(fit_rarity(docs, "text"))
    plain, better = (known_item_means(spark, folder, "dense", e)["mrr"] for e in (HashingEmbedder(256), weighted))
    assert better > plain


def test_blocks_hold_few_rows_and_small_parts(monkeypatch):
    """Rows that cannot be among a query's best are not gathered, and Arrow data comes in bounded parts."""
    import pyarrow as pa

    from lodgelens.operators import topk

    monkeypatch.setattr(topk, "MATRIX_CELLS", 64 * 100)
    monkeypatch.setattr(topk, "WAITING_ROWS", 1_000, raising=False)
    monkeypatch.setattr(topk, "PART_BYTES", 64 * 1024, raising=False)
    seen, best = [], topk._best
    monkeypatch.setattr(topk, "_best", lambda q, *more: seen.append(len(q)) or best(q, *more))
    rng = np.random.default_rng(1)
    wanted, vectors = rng.normal(size=(64, 8)), rng.normal(size=(20_000, 8))
    queries = pd.DataFrame({"query_id": range(64), "embedding": list(wanted), "route": "all"})
    items = pa.record_batch({"item_id": pa.array(range(20_000)), "embedding": pa.array(list(vectors)), "route": pa.array(["all"] * 20_000)})
    parts = list(topk._parts(items))
    assert len(parts) > 10 and sum(map(len, parts)) == 20_000
    blocks = topk._Blocks(dense.CosineScore(), queries, 5)
    for part in parts:
        blocks.add(part)
    got = blocks.result()
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    scores = np.round(unit(wanted) @ unit(vectors).T, 6)
    for q in range(64):
        assert got[got.query_id == q].item_id.tolist() == np.lexsort((np.arange(20_000), -scores[q]))[:5].tolist()
    assert max(seen) < 5_000


def test_long_texts_are_embedded_in_parts(monkeypatch):
    from lodgelens.operators import embedding

    monkeypatch.setattr(embedding, "PART_CHARS", 100, raising=False)
    model = embedding.HashingEmbedder(16)
    model.load()
    held, factorize = [], pd.factorize
    monkeypatch.setattr(embedding.pd, "factorize", lambda values: held.append(len(values)) or factorize(values))
    texts = ["", "uno due tre " * 30, "due", "", "tre quattro", "x " * 200]
    whole = np.vstack([model.embed([t]) for t in texts])
    held.clear()
    assert (model.embed(texts) == whole).all() and max(held) <= 210
    assert model.embed([]).shape == (0, 16)


def test_quantised_probes_of_most_cells_stay_one_row(spark, vectors, asked):
    """A query that probes most cells is one row with a bit per cell, and sees those cells only."""
    model = quantised.fit_quantiser(vectors)
    index = quantised.with_codes(vectors, model)
    most = model.cells - 1
    probes = quantised.probed(asked, model, most)
    assert probes.count() == asked.filter("embedding IS NOT NULL").count()
    n = vectors.count()
    got = {(r["query_id"], r["item_id"]) for r in quantised.short_lists(probes, index, model, n).collect()}
    cells = {r["chunk_id"]: r["cell"] for r in index.select("chunk_id", "cell").collect()}
    for row in asked.filter("embedding IS NOT NULL").limit(3).collect():
        unit = quantised._units([row["embedding"]])
        near = set(model.nearest_cells(unit, most)[0].tolist())
        assert {i for q, i in got if q == row["query_id"]} == {i for i, c in cells.items() if c in near}


def test_text_index_counts_where_texts_are_read(spark, monkeypatch, tmp_path):
    """No shuffle of words by text unless ids repeat; repeated and null ids count as one text's words."""
    monkeypatch.setattr(postings, "PIECE_WORDS", 7)
    plans = []
    plain = postings.materialise

    def seen(df, label, *more):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, label, *more)

    monkeypatch.setattr(postings, "materialise", seen)
    once = [(i, f"a b{i % 3} c{i} a") for i in range(20)] + [(50, ""), (51, None), (None, "a b1")]
    for rows, repeats in ((once, False), ([*once, (3, "a a zz"), (None, "b1")], True)):
        plans.clear()
        path = str(tmp_path / f"index{len(rows)}")
        postings.build_text_index(spark.createDataFrame(rows, "chunk_id long, chunk_text string"), path)
        [plan] = [p for label, p in plans if label == "postings"]
        assert ("hashpartitioning(chunk_id" in plan) == repeats
        tf = Counter((i, w) for i, t in rows for w in (t or "").split())
        held = spark.read.parquet(f"{path}/postings").selectExpr("term", "top", "explode(postings) AS p").collect()
        assert len(held) == len(tf) and {(r["p"]["chunk_id"], r["term"]) for r in held} == set(tf)
        assert all(r["p"]["impact"] <= r["top"] for r in held)
        df = {r["term"]: r["df"] for r in spark.read.parquet(f"{path}/terms").collect()}
        assert df == Counter(w for _, w in tf)
