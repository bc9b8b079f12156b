"""From a table of questions to grounded prompts."""

from __future__ import annotations

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.operators.dense import knn_ann, knn_filtered
from lodgelens.operators.embedding import Embedder, embed_text
from lodgelens.operators.fusion import reciprocal_rank_fusion
from lodgelens.operators.lexical import lexical_topk
from lodgelens.operators.prompts import NO_REVIEWS, assemble_prompts, context_lists, instruction_for
from lodgelens.operators.rerank import (
    PLACE_RERANK_K,
    PLACE_RETRIEVE_K,
    RERANK_K,
    RETRIEVE_K,
    PairScorer,
    pair_join,
    rerank_topk,
)
from lodgelens.operators.routing import resolve_scopes
from lodgelens.session import materialise

# Fixed value: the reply to a question that names neither a place nor a listing.
CLARIFY = (
    "La domanda è ampia per un'intera città: le recensioni variano molto da zona a zona e "
    "da alloggio ad alloggio. Su quale **quartiere** vuoi concentrarti? "
    "(oppure scegli un annuncio dalla mappa)"
)


def retrieve_then_rerank(
    queries: DataFrame,
    chunks: DataFrame,
    embedder: Embedder | None = None,
    scorer: PairScorer | None = None,
    mode: str = "dense",
    cells: KMeansModel | None = None,
) -> DataFrame:
    """Best reranked chunks per query, within its filters.

    ``queries`` are ``(query_id, query, listing_id, neighbourhood)``. A place-wide query
    goes deeper (40 to 8) than one about a listing or the whole table (20 to 3). The cheap
    first stage sees all chunks; the scorer sees only its hits. ``mode`` is ``dense``,
    ``lexical`` or ``hybrid``; with a ``cells`` model the vector part is approximate.
    """
    place_wide = F.col("neighbourhood").isNotNull() & F.col("listing_id").isNull()
    asked = queries.withColumns(
        {
            "retrieve_k": F.when(place_wide, PLACE_RETRIEVE_K).otherwise(RETRIEVE_K),
            "rerank_k": F.when(place_wide, PLACE_RERANK_K).otherwise(RERANK_K),
        }
    )
    deepest = max(RETRIEVE_K, PLACE_RETRIEVE_K)
    lists = []
    if mode in ("dense", "hybrid"):
        vectors = chunks if "embedding" in chunks.columns else embed_text(chunks, "chunk_text", embedder)
        embedded = embed_text(asked, "query", embedder)
        if cells is None:
            lists.append(knn_filtered(embedded, vectors, deepest))
        else:
            lists.append(knn_ann(embedded, vectors, cells, deepest, filtered=True))
    if mode in ("lexical", "hybrid"):
        lists.append(lexical_topk(asked, chunks, deepest, filtered=True))
    found = lists[0] if len(lists) == 1 else reciprocal_rank_fusion(*lists, k=deepest)
    depths = asked.select("query_id", "retrieve_k", "rerank_k")
    hits = found.join(depths, "query_id").filter(F.col("rank") <= F.col("retrieve_k"))
    texts = chunks.select("chunk_id", "listing_id", "neighbourhood", "room_type", "chunk_text")
    pairs = pair_join(hits, texts, queries, deepest)
    return rerank_topk(pairs, F.col("rerank_k"), scorer, deepest=max(RERANK_K, PLACE_RERANK_K))


def plan_answers(
    questions: DataFrame,
    places: DataFrame,
    listings: DataFrame,
    chunks: DataFrame,
    embedder: Embedder | None = None,
    scorer: PairScorer | None = None,
    mode: str = "dense",
    instructions: dict[str, str] | None = None,
) -> DataFrame:
    """What a client or a model needs for each question, one row per question.

    ``question_id, route, n_contexts, prompt, reply`` and

    * ``instruction``: what the model is told besides the prompt, by route; null with a fixed reply;
    * ``contexts``: place, score and text of the reviews the prompt holds, best first (else empty);
    * ``listing_name``, ``neighbourhood``: what the question was found to be about;
    * ``places``: with the route ``clarify``, the names to choose from, in order.

    Review questions get a prompt, unless there is nothing to ground it on: then the
    fixed reply is final. Other routes are left to the SQL or small-talk branch.
    ``places`` is a list of a city's districts: it is put as one value beside the questions.
    """
    routed = materialise(resolve_scopes(questions, places, listings), "routes")
    grounded = routed.filter(F.col("route").isin("listing", "place")).select(
        F.col("question_id").alias("query_id"),
        F.col("text").alias("query"),
        "listing_id",
        F.when(F.col("route") == "place", F.col("neighbourhood")).alias("neighbourhood"),
        F.when(F.col("route") == "listing", F.col("listing_name")).alias("listing_name"),
    )
    # Read for the prompts and for the lists: at most eight rows per question.
    best = retrieve_then_rerank(grounded.drop("listing_name"), chunks, embedder, scorer, mode)
    best = materialise(best, "contexts")
    prompts = assemble_prompts(grounded, best).withColumnRenamed("query_id", "question_id")
    shown = context_lists(best, "query_id").withColumnRenamed("query_id", "question_id")
    joined = routed.join(prompts, "question_id", "left").join(shown, "question_id", "left")
    no_reviews = F.concat(
        F.lit(NO_REVIEWS[0]), F.coalesce("listing_name", F.lit("None")), F.lit(NO_REVIEWS[1])
    )
    clarify = F.col("route") == "clarify"
    reply = F.when(clarify, CLARIFY).when(
        (F.col("route") == "listing") & (F.col("n_contexts") == 0), no_reviews
    )
    offered = places.agg(F.array_sort(F.collect_set("place_name")).alias("names")).scalar()
    none = F.array().cast(shown.schema["contexts"].dataType)
    return joined.select(
        "question_id",
        "route",
        F.coalesce("n_contexts", F.lit(0)).alias("n_contexts"),
        F.when(reply.isNull(), F.col("prompt")).alias("prompt"),
        reply.alias("reply"),
        F.when(reply.isNull(), instruction_for(F.col("route"), instructions)).alias("instruction"),
        F.coalesce("contexts", none).alias("contexts"),
        F.when(F.col("route") == "listing", F.col("listing_name")).alias("listing_name"),
        F.when(F.col("route") == "place", F.col("neighbourhood")).alias("neighbourhood"),
        F.when(clarify, offered).alias("places"),
    )
