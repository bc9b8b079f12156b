"""Grounded prompts and streamed answers as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.once import with_once
from lodgelens.functions.replies import delta_text

# The Italian wording of the prompt.
BLOCK_TITLE = "### Recensione "
NO_CONTEXT = "(nessun contesto recuperato)"
CONTEXT_TITLE = "Contesto (recensioni recuperate):"
QUESTION_TITLE = "Domanda: "
ANSWER_TITLE = "Risposta grounded sul contesto:"
LISTING_INTRO = ("Le recensioni riguardano l'alloggio «", "».")
NO_REVIEWS = ("Non ci sono recensioni disponibili per «", "».")

_REVIEWS = (
    "Rispondi usando soltanto le recensioni del contesto e nella lingua della domanda. Se non contengono "
    "la risposta, dillo. Riporta i fatti concreti raccontati dagli ospiti, senza marcatori di citazione."
)
#: What a model is told besides the prompt, by route; ``clarify`` asks no model.
INSTRUCTIONS = {
    "listing": _REVIEWS + " Le recensioni parlano di un solo alloggio: chiamalo per nome.",
    "place": _REVIEWS + " Le recensioni vengono da alloggi diversi dello stesso quartiere: dai un quadro "
    "d'insieme e precisa che l'esperienza cambia da un alloggio all'altro.",
    "analytics": "Racconta il risultato a parole, partendo dai numeri e nella lingua della domanda, senza "
    "nominare tabelle, colonne o SQL. Se il dato non c'è, spiegalo.",
    "conversational": "Rispondi in breve e invita a chiedere di prezzi, quartieri e recensioni.",
}


def instruction_for(route: Column, instructions: dict[str, str] | None = None) -> Column:
    """The instruction that goes with a route; null for routes without one."""
    pairs = (instructions or INSTRUCTIONS).items()
    return F.coalesce(*[F.when(route == name, text) for name, text in pairs], F.lit(None).cast("string"))


def context_block(rank: Column, neighbourhood: Column, room_type: Column, text: Column) -> Column:
    unknown = F.lit("?")
    return F.concat(
        F.lit(BLOCK_TITLE),
        rank.cast("string"),
        F.lit(" ["),
        F.coalesce(neighbourhood, unknown),
        F.lit(" / "),
        F.coalesce(room_type, unknown),
        F.lit("]\n"),
        text,
    )


def assemble_prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(query_id, n_contexts, prompt)`` for every query, with or without hits.

    ``contexts`` holds the few reranked rows per query, numbered by ``rerank_rank``;
    ``queries`` may carry a ``listing_name`` to open the prompt with.
    """
    block = context_block(
        F.col("rerank_rank"), F.col("neighbourhood"), F.col("room_type"), F.col("chunk_text")
    )
    blocks = contexts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rerank_rank", block.alias("block")))).alias("blocks")
    )
    listing = F.col("listing_name") if "listing_name" in queries.columns else F.lit(None)
    intro = F.when(
        F.coalesce(listing, F.lit("")) != "",
        F.concat(F.lit(LISTING_INTRO[0]), listing, F.lit(LISTING_INTRO[1] + "\n\n")),
    ).otherwise("")
    body = F.coalesce(F.array_join(F.col("blocks.block"), "\n\n"), F.lit(NO_CONTEXT))
    prompt = F.concat(
        intro,
        F.lit(CONTEXT_TITLE + "\n\n"),
        body,
        F.lit("\n\n" + QUESTION_TITLE),
        F.col("query"),
        F.lit("\n\n" + ANSWER_TITLE),
    )
    return queries.join(blocks, "query_id", "left").select(
        "query_id", F.coalesce(F.size("blocks"), F.lit(0)).alias("n_contexts"), prompt.alias("prompt")
    )


def context_view(df: DataFrame, key: str | Column) -> DataFrame:
    """What a client sees of a context: place, score to two places, first 400 characters."""
    return df.select(
        key,
        "neighbourhood",
        F.bround(F.coalesce("rerank_score", F.lit(0.0)), 2).alias("score"),
        F.substring(F.coalesce("chunk_text", F.lit("")), 1, 400).alias("text"),
    )


def context_lists(contexts: DataFrame, key: str) -> DataFrame:
    """``(key, contexts)``: what a client sees of the few contexts of a question, best first."""
    seen = context_view(contexts, F.struct(key, "rerank_rank").alias("at"))
    shown = F.struct(F.col("at.rerank_rank").alias("rank"), "neighbourhood", "score", "text")
    return seen.groupBy(F.col(f"at.{key}").alias(key)).agg(F.array_sort(F.collect_list(shown)).alias("contexts"))


def join_deltas(events: DataFrame, key: str, seq: str, payload: str) -> DataFrame:
    """The whole answer per key out of its streamed events, in order.

    Events without answer text are dropped before the shuffle. An answer is one value,
    so its pieces meet in one row; different answers are independent.
    """
    parsed = events.select(key, seq, F.try_parse_json(payload).alias("doc"))
    pieces = with_once(parsed.select(key, seq, "doc"), {"piece": delta_text(F.col("doc"))})
    pieces = pieces.filter(F.length("piece") > 0)
    ordered = F.array_sort(F.collect_list(F.struct(seq, "piece")))
    return pieces.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("answer"),
        F.count("*").alias("n_pieces"),
    )
