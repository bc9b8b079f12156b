"""Vector and word search, fusion, reranking, prompts and their metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.catalog.registry import load, query
from lodgelens.operators import dense, evaluation, fusion, lexical, postings, prompts, quantised, ranking, rerank
from lodgelens.operators.embedding import WeightedEmbedder, embed_text, fit_rarity
from lodgelens.plans.answering import CLARIFY, plan_answers
from lodgelens.plans.answering import retrieve_then_rerank as retrieve
from lodgelens.session import materialise, scratch_path, spread_few_splits

WORDS = "regexp_extract_all(lower({}), '[a-z0-9àèéìòùáéíóú&]+')"


# ------------------------------------------------------------------ stored vectors


def stored_chunks(spark, folder):
    """Every stored vector as a chunk of listing ``label`` and one of two places."""
    return load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        "embedding",
        F.col("label").cast("bigint").alias("listing_id"),
        F.when(F.col("label") < 5, "north").otherwise("south").alias("neighbourhood"),
    )


def stored_queries(spark, folder):
    return load(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


PAIRS_SQL = """
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS q_label, c.label AS c_label,
                     round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
              FROM embeddings q, embeddings c)
"""


def _ranked(source: str, k: int) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k})"""


@query(
    "knn_exact",
    f"WITH {PAIRS_SQL} SELECT query_id, rank, chunk_id, score FROM {_ranked('pairs', 20)}",
)
def knn_exact(spark, folder):
    return dense.knn_exact(stored_queries(spark, folder), stored_chunks(spark, folder))


@query(
    "knn_filtered",
    f"""
    WITH {PAIRS_SQL},
    allowed AS (SELECT query_id, chunk_id, score FROM pairs WHERE CASE
        WHEN q_label < 3 THEN c_label = q_label + 1
        WHEN q_label < 6 THEN c_label < 5
        WHEN q_label < 8 THEN c_label = q_label AND c_label >= 5
        ELSE true END)
    SELECT query_id, rank, chunk_id, score FROM {_ranked("allowed", 20)}
    """,
)
def knn_filtered(spark, folder):
    """Filters by label: a listing, a place, both, or none."""
    label = F.col("label")
    listing = F.when(label < 3, label + 1).when((label >= 6) & (label < 8), label)
    place = F.when((label >= 3) & (label < 6), " North ").when((label >= 6) & (label < 8), "SOUTH")
    asked = load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        "embedding",
        listing.cast("bigint").alias("listing_id"),
        place.alias("neighbourhood"),
    )
    return dense.knn_filtered(asked, stored_chunks(spark, folder))


def quantised_index(spark, folder):
    chunks = spread_few_splits(stored_chunks(spark, folder), "chunk_id")
    model = quantised.fit_quantiser(chunks)
    return materialise(quantised.with_codes(chunks, model), "vector-index"), model


@query("knn_ann")
def knn_ann(spark, folder):
    """Product-quantised residuals in two-level cells; the short list is scored exactly."""
    index, model = quantised_index(spark, folder)
    return quantised.knn_quantised(stored_queries(spark, folder), index, model, k=20)


@query(
    "knn_ann_recall",
    """
    SELECT count(*) FILTER (vec_id % 50 = 0) AS n_queries, count(*) AS n_items, true AS recall_reached,
           true AS tenth_kept FROM embeddings
    """,
)
def knn_ann_recall(spark, folder):
    """Recall at 10 against brute force over all rows, and the share of pairs that is scored exactly.

    The queries are the stated set of the rows whose id 50 divides.
    """
    index, model = quantised_index(spark, folder)
    asked = stored_queries(spark, folder).filter("query_id % 50 = 0")
    probes = materialise(quantised.probed(asked, model), "probed")
    short = materialise(quantised.short_lists(probes, index, model), "short-lists")
    near = quantised.rescored(short, asked, index, 10).select("query_id", "chunk_id")
    exact = dense.knn_exact(asked, stored_chunks(spark, folder), 10).select("query_id", "chunk_id")
    found = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    counts = [
        asked.agg(F.lit("queries").alias("what"), F.count("*").alias("n")),
        index.agg(F.lit("items").alias("what"), F.count("*").alias("n")),
        short.agg(F.lit("scored").alias("what"), F.count("*").alias("n")),
        found.agg(F.lit("wanted").alias("what"), F.count("*").alias("n")),
        found.agg(F.lit("found").alias("what"), F.count("hit").alias("n")),
    ]

    def of(what: str):
        return F.max(F.when(F.col("what") == what, F.col("n")))

    return reduce(DataFrame.union, counts).agg(
        of("queries").alias("n_queries"),
        of("items").alias("n_items"),
        (of("found") >= 0.9 * of("wanted")).alias("recall_reached"),
        (of("scored") <= of("queries") * of("items") / 10).alias("tenth_kept"),
    )


@query(
    "rank_hits",
    f"WITH {PAIRS_SQL} SELECT query_id, rank, chunk_id FROM {_ranked('pairs', 10)}",
)
def rank_hits(spark, folder):
    hits = dense.knn_exact(stored_queries(spark, folder), stored_chunks(spark, folder), k=10)
    ranked = evaluation.rank_hits(hits.drop("rank"), [F.desc("score"), F.asc("chunk_id")])
    return ranked.select("query_id", "rank", "chunk_id")


def labelled_hits(spark, folder):
    """Top 20 per stored vector, with the chunk's listing; a query likes the next two labels."""
    chunks = stored_chunks(spark, folder)
    hits = dense.knn_exact(stored_queries(spark, folder), chunks)
    with_listing = hits.join(chunks.select("chunk_id", "listing_id"), "chunk_id")
    near = F.explode(F.array((F.col("label") + 1) % 10, (F.col("label") + 2) % 10))
    wanted = load(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), near.alias("l"))
    qrels = wanted.select("query_id", F.col("l").cast("string").alias("listing_id"))
    return with_listing, qrels


HITS_SQL = f"""
    {PAIRS_SQL},
    hits AS (SELECT query_id, rank, chunk_id, c_label AS listing,
                    (c_label IN ((q_label + 1) % 10, (q_label + 2) % 10))::INTEGER AS rel
             FROM {_ranked("pairs", 20)}),
    listing_first AS (SELECT query_id, listing, rel, min(rank) AS first_rank FROM hits GROUP BY ALL),
    listing_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS lr
                       FROM listing_first)
"""


def _ideal(k: int) -> str:
    return "(" + " + ".join(f"1 / log2({i + 1}::DOUBLE)" for i in range(1, min(2, k) + 1)) + ")"


def _metric_columns() -> str:
    columns = []
    for k in (3, 5, 10):
        columns += [
            f"(SELECT count(*) FROM listing_first f WHERE f.query_id = h.query_id AND rel = 1"
            f" AND first_rank <= {k}) / 2.0::DOUBLE AS recall_{k}",
            f"sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) / {_ideal(k)} AS ndcg_chunk_{k}",
            f"(SELECT coalesce(sum(rel / log2(lr + 1)), 0) FROM listing_ranked f"
            f" WHERE f.query_id = h.query_id AND lr <= {k}) / {_ideal(k)} AS ndcg_listing_{k}",
        ]
    return ", ".join(columns)


METRICS = ["mrr"] + [f"{m}_{k}" for k in (3, 5, 10) for m in ("recall", "ndcg_chunk", "ndcg_listing")]
METRICS_SQL = f"""
    {HITS_SQL},
    metrics AS (SELECT query_id, 2::BIGINT AS n_relevant,
                       coalesce(max(CASE WHEN rel = 1 THEN 1.0::DOUBLE / rank END), 0) AS mrr,
                       {_metric_columns()} FROM hits h GROUP BY query_id)
"""


@query(
    "join_qrels",
    f"WITH {HITS_SQL} SELECT query_id, rank, listing::VARCHAR AS listing_id, rel FROM hits",
)
def join_qrels(spark, folder):
    marked = evaluation.join_qrels(*labelled_hits(spark, folder))
    return marked.select("query_id", "rank", "listing_id", "rel")


@query(
    "ir_metrics",
    f"""
    WITH {METRICS_SQL}
    SELECT query_id, n_relevant, {", ".join(f"round({m}, 6) AS {m}" for m in METRICS)} FROM metrics
    """,
)
def ir_metrics(spark, folder):
    per_query = evaluation.ir_metrics(*labelled_hits(spark, folder))
    return per_query.select(
        "query_id", "n_relevant", *[F.round(F.col(m), 6).alias(m) for m in METRICS]
    )


@query(
    "macro_mean",
    f"""
    WITH {METRICS_SQL}
    SELECT {", ".join(f"round_even(avg({m}), 4) AS {m}" for m in METRICS)}, count(*) AS n_queries FROM metrics
    """,
)
def macro_mean(spark, folder):
    return evaluation.macro_mean(evaluation.ir_metrics(*labelled_hits(spark, folder)))


@query(
    "set_overlap",
    f"WITH {METRICS_SQL} SELECT query_id, recall_3, recall_5, recall_10 FROM metrics",
)
def set_overlap(spark, folder):
    per_query = evaluation.ir_metrics(*labelled_hits(spark, folder))
    return per_query.select("query_id", "recall_3", "recall_5", "recall_10")


# ------------------------------------------------------------------ texts


def text_chunks(spark, folder):
    """Documents as chunks: language as place, source number as listing."""
    docs = load(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.regexp_extract("source", r"(\d+)", 1).cast("bigint").alias("listing_id"),
        F.col("lang").alias("neighbourhood"),
        F.col("source").alias("room_type"),
        F.col("text").alias("chunk_text"),
    )
    return spread_few_splits(docs, "chunk_id")


def text_queries(spark, folder):
    return load(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def _hashed(table: str, key: str, out: str) -> str:
    return f"""
    {out}_tokens AS (SELECT {key} AS id, unnest({WORDS.format("text")}) AS w FROM {table}),
    {out}_buckets AS (
        SELECT id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64 AS bucket,
               sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS v
        FROM {out}_tokens GROUP BY ALL HAVING v <> 0),
    {out}_norms AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {out}_buckets GROUP BY id)
    """


DOC_VECTORS_SQL = _hashed("documents", "doc_id", "d")
DENSE_SQL = f"""
    {DOC_VECTORS_SQL},
    {_hashed("benchmark", "item_id", "q")},
    dots AS (SELECT q.id AS query_id, d.id AS chunk_id, sum(q.v * d.v) AS dot
             FROM q_buckets q JOIN d_buckets d USING (bucket) GROUP BY ALL),
    dense AS (SELECT q.id AS query_id, d.id AS chunk_id,
                     round(coalesce(dot, 0) / (q.norm * d.norm), 6) AS score
              FROM q_norms q CROSS JOIN d_norms d
              LEFT JOIN dots ON dots.query_id = q.id AND dots.chunk_id = d.id)
"""


@query(
    "embed_text",
    f"""
    WITH {DOC_VECTORS_SQL}
    SELECT id AS chunk_id, bucket::INTEGER AS bucket, round(v / norm, 6) AS weight
    FROM d_buckets JOIN d_norms USING (id)
    """,
)
def embed_text_query(spark, folder):
    vectors = embed_text(text_chunks(spark, folder), "chunk_text")
    cells = vectors.select("chunk_id", F.posexplode("embedding").alias("bucket", "weight"))
    return cells.filter("weight <> 0").withColumn("weight", F.round("weight", 6))


@query(
    "embed_text_weighted",
    f"""
    WITH words AS (SELECT doc_id AS id, unnest({WORDS.format("text")}) AS w FROM documents),
    coded AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::UBIGINT AS code,
                     CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS sign FROM words),
    rare AS (SELECT code % 262144 AS slot,
                    ln(((SELECT count(text) FROM documents) + 1)::DOUBLE / (count(DISTINCT id) + 1)) + 1 AS idf
             FROM coded GROUP BY slot),
    cells AS (SELECT id, code % 256 AS bucket, sum(sign * idf) AS v FROM coded JOIN rare ON code % 262144 = slot
              GROUP BY ALL),
    norms AS (SELECT id, sqrt(sum(v * v)) AS norm FROM cells GROUP BY id)
    SELECT id AS chunk_id, bucket::INTEGER AS bucket, round(v / norm, 6) AS weight
    FROM cells JOIN norms USING (id) WHERE abs(v / norm) > 1e-6
    """,
)
def embed_text_weighted(spark, folder):
    """Vectors of words weighted by rarity among all texts; what cancels out is no cell."""
    chunks = text_chunks(spark, folder)
    vectors = embed_text(chunks, "chunk_text", WeightedEmbedder(fit_rarity(chunks, "chunk_text")))
    cells = vectors.select("chunk_id", F.posexplode("embedding").alias("bucket", "weight"))
    return cells.filter("abs(weight) > 1e-6").withColumn("weight", F.round("weight", 6))


BM25_SQL = f"""
    docs AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
    corpus AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM docs),
    tf AS (SELECT doc_id, w, len_d, count(*) AS tf FROM (
               SELECT doc_id, len(ws) AS len_d, unnest(ws) AS w FROM docs) GROUP BY ALL),
    df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
    terms AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format("text")}) AS w FROM benchmark),
    bm25 AS (SELECT query_id, doc_id AS chunk_id, round(sum(
                 ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
                 / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len_d / avg_len))), 6) AS score
             FROM terms JOIN tf USING (w) JOIN df USING (w), corpus GROUP BY ALL),
    bm25_top AS (SELECT query_id, chunk_id, score, rank FROM {_ranked("bm25", 20)})
"""


@query("lexical_topk", f"WITH {BM25_SQL} SELECT query_id, rank, chunk_id, score FROM bm25_top")
def lexical_topk(spark, folder):
    return lexical.lexical_topk(text_queries(spark, folder), text_chunks(spark, folder))


@query("lexical_index_topk", f"WITH {BM25_SQL} SELECT query_id, rank, chunk_id, score FROM bm25_top")
def lexical_index_topk(spark, folder):
    """The same search from a stored index of postings, in two batches of questions."""
    path = scratch_path(spark, "text-index")
    postings.build_text_index(text_chunks(spark, folder), path)
    asked = text_queries(spark, folder)
    even = F.col("query_id") % 2 == 0
    first, second = (postings.search_text_index(asked.filter(batch), path) for batch in (even, ~even))
    return first.union(second)


@query(
    "hybrid_fuse",
    f"""
    WITH {BM25_SQL}, {DENSE_SQL},
    dense_top AS (SELECT query_id, chunk_id, rank FROM {_ranked("dense", 20)}),
    gains AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS gain FROM bm25_top
              UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) FROM dense_top),
    fused AS (SELECT query_id, chunk_id, round(sum(gain), 8) AS score FROM gains GROUP BY ALL)
    SELECT query_id, rank, chunk_id, score FROM {_ranked("fused", 20)}
    """,
)
def hybrid_fuse(spark, folder):
    asked, chunks = text_queries(spark, folder), text_chunks(spark, folder)
    by_words = lexical.lexical_topk(asked, chunks)
    by_vector = dense.knn_exact(embed_text(asked, "query"), embed_text(chunks, "chunk_text"))
    return fusion.reciprocal_rank_fusion(by_vector, by_words)


def scored_pairs(spark, folder):
    """Pairs of questions and their 20 best texts."""
    asked, chunks = text_queries(spark, folder), text_chunks(spark, folder)
    hits = lexical.lexical_topk(asked, chunks, rerank.RETRIEVE_K)
    return rerank.pair_join(hits, chunks, asked, rerank.RETRIEVE_K)


@query(
    "pair_join",
    f"""
    WITH {BM25_SQL}
    SELECT query_id, rank, chunk_id, md5(b.text) AS asked, md5(d.text) AS said
    FROM bm25_top JOIN benchmark b ON query_id = item_id JOIN documents d ON chunk_id = doc_id
    """,
)
def pair_join(spark, folder):
    return scored_pairs(spark, folder).select(
        "query_id", "rank", "chunk_id", F.md5("query").alias("asked"), F.md5("chunk_text").alias("said")
    )


OVERLAP_SQL = f"""
    (SELECT *, round(len(list_intersect(list_distinct({WORDS.format("asked")}),
                                        list_distinct({WORDS.format("said")})))
                     / len(list_distinct({WORDS.format("asked")}))::DOUBLE, 6) AS rerank_score FROM pairs)
"""
RERANKED_SQL = f"""
    {BM25_SQL},
    pairs AS (SELECT query_id, rank, chunk_id, b.text AS asked, d.text AS said
              FROM bm25_top JOIN benchmark b ON query_id = item_id JOIN documents d ON chunk_id = doc_id),
    reranked AS (SELECT * FROM (SELECT *, row_number() OVER (
                    PARTITION BY query_id ORDER BY rerank_score DESC, rank, chunk_id) AS rerank_rank
                 FROM {OVERLAP_SQL}) WHERE rerank_rank <= 3)
"""


@query(
    "rerank_topk",
    f"WITH {RERANKED_SQL} SELECT query_id, rerank_rank, chunk_id, rerank_score FROM reranked",
)
def rerank_topk(spark, folder):
    best = rerank.rerank_topk(scored_pairs(spark, folder))
    return best.select("query_id", "rerank_rank", "chunk_id", "rerank_score")


@query(
    "prompt_assemble",
    f"""
    WITH {RERANKED_SQL},
    kept AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank) AS pos, said,
                    lang, CASE WHEN toxic = 0 THEN source END AS room
             FROM reranked JOIN documents ON chunk_id = doc_id JOIN labels USING (doc_id)),
    bodies AS (SELECT query_id, count(*) AS n, string_agg('### Recensione ' || pos || ' [' || lang || ' / '
                      || coalesce(room, '?') || ']' || chr(10) || said, chr(10) || chr(10) ORDER BY pos) AS body
               FROM kept GROUP BY query_id)
    SELECT item_id AS query_id, coalesce(n, 0)::INTEGER AS n_contexts,
           CASE WHEN item_id % 2 = 0 THEN 'Le recensioni riguardano l''alloggio «Casa ' || item_id || '».'
                || chr(10) || chr(10) ELSE '' END
           || 'Contesto (recensioni recuperate):' || chr(10) || chr(10)
           || coalesce(body, '(nessun contesto recuperato)') || chr(10) || chr(10) || 'Domanda: ' || text
           || chr(10) || chr(10) || 'Risposta grounded sul contesto:' AS prompt
    FROM benchmark LEFT JOIN bodies ON item_id = query_id
    """,
)
def prompt_assemble(spark, folder):
    """Labelled texts only, so some questions keep fewer contexts or none."""
    best = rerank.rerank_topk(scored_pairs(spark, folder))
    labels = load(spark, folder, "labels").withColumnRenamed("doc_id", "chunk_id")
    kept = best.join(labels, "chunk_id").withColumn(
        "room_type", F.when(F.col("toxic") == 0, F.col("room_type"))
    )
    numbered = ranking.top_per_key(
        kept.drop("rerank_rank"),
        ["query_id"],
        [F.desc("rerank_score"), F.asc("rank")],
        rerank.RERANK_K,
        tie="chunk_id",
        rank="rerank_rank",
    )
    even = F.col("query_id") % 2 == 0
    named = text_queries(spark, folder).withColumn(
        "listing_name", F.when(even, F.concat(F.lit("Casa "), F.col("query_id")))
    )
    return prompts.assemble_prompts(named, numbered)


@query(
    "retrieve_then_rerank",
    f"""
    WITH {DENSE_SQL},
    allowed AS (
        SELECT query_id, chunk_id, score FROM dense JOIN documents ON chunk_id = doc_id
        WHERE CASE query_id % 3 WHEN 1 THEN lang = 'en' WHEN 2 THEN source = 'src' || (query_id % 20)
              ELSE true END),
    pairs AS (SELECT r.*, b.text AS asked, d.text AS said FROM {_ranked("allowed", 40)} r
              JOIN benchmark b ON query_id = item_id JOIN documents d ON chunk_id = doc_id
              WHERE rank <= CASE query_id % 3 WHEN 1 THEN 40 ELSE 20 END)
    SELECT query_id, rerank_rank, chunk_id, rerank_score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, chunk_id)
                  AS rerank_rank FROM {OVERLAP_SQL})
    WHERE rerank_rank <= CASE query_id % 3 WHEN 1 THEN 8 ELSE 3 END
    """,
)
def retrieve_then_rerank(spark, folder):
    """Every third question is open, place-wide or about one listing."""
    kind = F.col("query_id") % 3
    asked = text_queries(spark, folder).withColumns(
        {
            "listing_id": F.when(kind == 2, F.col("query_id") % 20),
            "neighbourhood": F.when(kind == 1, "EN "),
        }
    )
    best = retrieve(asked, text_chunks(spark, folder))
    return best.select("query_id", "rerank_rank", "chunk_id", "rerank_score")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _instruction_sql() -> str:
    return " ".join(f"WHEN '{route}' THEN {_quoted(text)}" for route, text in prompts.INSTRUCTIONS.items())


@query(
    "answer_plans",
    f"""
    WITH {DENSE_SQL},
    asked AS (SELECT item_id AS query_id, text AS q, CASE item_id % 4 WHEN 0 THEN 'listing' WHEN 1 THEN 'place'
                     WHEN 2 THEN 'conversational' ELSE 'clarify' END AS route FROM benchmark),
    allowed AS (
        SELECT query_id, chunk_id, score, route, q FROM dense JOIN asked USING (query_id) JOIN documents ON chunk_id = doc_id
        WHERE CASE route WHEN 'place' THEN lang = 'en' WHEN 'listing' THEN source = 'src' || (query_id % 20) ELSE false END),
    pairs AS (SELECT r.*, r.q AS asked, d.text AS said, d.lang, d.source FROM {_ranked("allowed", 40)} r
              JOIN documents d ON chunk_id = doc_id WHERE rank <= CASE route WHEN 'place' THEN 40 ELSE 20 END),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (
                 PARTITION BY query_id ORDER BY rerank_score DESC, rank, chunk_id) AS pos FROM {OVERLAP_SQL})
             WHERE pos <= CASE route WHEN 'place' THEN 8 ELSE 3 END),
    bodies AS (SELECT query_id, count(*) AS n,
                      string_agg(lang || ':' || round_even(rerank_score, 2)::DOUBLE || ':' || left(said, 400), '|' ORDER BY pos) AS shown,
                      string_agg('### Recensione ' || pos || ' [' || lang || ' / ' || source || ']' || chr(10) || said,
                                 chr(10) || chr(10) ORDER BY pos) AS body
               FROM best GROUP BY query_id),
    planned AS (SELECT a.*, coalesce(n, 0) AS n_contexts, shown, body,
                       CASE WHEN route = 'clarify' THEN {_quoted(CLARIFY)}
                            WHEN route = 'listing' AND n IS NULL
                            THEN 'Non ci sono recensioni disponibili per «Casa ' || query_id || '».' END AS reply
                FROM asked a LEFT JOIN bodies USING (query_id))
    SELECT query_id AS question_id, route, n_contexts::INTEGER AS n_contexts, reply,
           CASE WHEN reply IS NULL AND route IN ('listing', 'place') THEN md5(
               CASE WHEN route = 'listing' THEN 'Le recensioni riguardano l''alloggio «Casa ' || query_id || '».'
                    || chr(10) || chr(10) ELSE '' END
               || 'Contesto (recensioni recuperate):' || chr(10) || chr(10) || coalesce(body, '(nessun contesto recuperato)')
               || chr(10) || chr(10) || 'Domanda: ' || q || chr(10) || chr(10) || 'Risposta grounded sul contesto:') END AS prompt,
           CASE WHEN reply IS NULL THEN CASE route {_instruction_sql()} END END AS instruction,
           coalesce(shown, '') AS contexts,
           CASE WHEN route = 'listing' THEN 'Casa ' || query_id WHEN route = 'place' THEN 'EN ' END AS about,
           CASE WHEN route = 'clarify' THEN (SELECT string_agg(DISTINCT lang, ', ' ORDER BY lang) FROM documents) END AS places
    FROM planned
    """,
)
def answer_plans(spark, folder):
    """Benchmark items as questions: about a listing, about a place, small talk, or about nothing named."""
    kind = F.col("item_id") % 4
    scope = F.struct(
        F.when(kind == 0, "listing").otherwise("neighbourhood").alias("kind"),
        (F.col("item_id") % 20).alias("listing_id"),
        F.lit("EN ").alias("neighbourhood"),
        F.concat(F.lit("Casa "), F.col("item_id")).alias("label"),
    )
    questions = load(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"),
        "text",
        F.when(kind == 2, "conversational").otherwise("rag").alias("intent"),
        F.when(kind < 2, scope).alias("scope"),
    )
    places = load(spark, folder, "documents").select(F.col("lang").alias("place_name")).distinct()
    known = load(spark, folder, "part").select(F.col("p_partkey").alias("listing_id"), F.col("p_name").alias("listing_name"))
    plans = plan_answers(questions, places, known, text_chunks(spark, folder))
    line = F.transform("contexts", lambda c: F.concat_ws(":", c["neighbourhood"], c["score"].cast("string"), c["text"]))
    return plans.select(
        "question_id",
        "route",
        "n_contexts",
        "reply",
        F.md5("prompt").alias("prompt"),
        "instruction",
        F.array_join(line, "|").alias("contexts"),
        F.coalesce("listing_name", "neighbourhood").alias("about"),
        F.array_join("places", ", ").alias("places"),
    )
