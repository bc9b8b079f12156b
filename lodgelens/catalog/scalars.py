"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.catalog.joins import (
    _phrases_sql,
    name_match_sql,
    place_match_sql,
    utterances,
    word_places,
)
from lodgelens.catalog.registry import load, query
from lodgelens.functions import intents, text, values
from lodgelens.functions.language import STOP_WORDS, with_language
from lodgelens.functions.replies import with_response_text
from lodgelens.operators import chunks, evaluation, prompts, routing
from lodgelens.session import spread_few_splits

WORDS = "regexp_extract_all(lower({}), '[a-z0-9àèéìòùáéíóú&]+')"


@query(
    "parse_price",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS price FROM customer",
)
def parse_price(spark, folder):
    """Balances as money text: blanks for debts, ``$`` and thousands marks for the rest."""
    money = F.when(F.col("c_acctbal") < 0, "").otherwise(
        F.concat(F.lit("$"), F.format_number("c_acctbal", 2))
    )
    return load(spark, folder, "customer").select("c_custkey", values.parse_price(money).alias("price"))


STRIPPED_SQL = "trim(regexp_replace(html, '<[^>]+>', ' ', 'g'))"


@query("strip_tags", f"SELECT page_id, {STRIPPED_SQL} AS body FROM pages")
def strip_tags(spark, folder):
    return load(spark, folder, "pages").select("page_id", text.strip_tags(F.col("html")).alias("body"))


@query(
    "squash_space",
    rf"SELECT page_id, trim(regexp_replace({STRIPPED_SQL}, '\s+', ' ', 'g')) AS body FROM pages",
)
def squash_space(spark, folder):
    body = text.squash_space(text.strip_tags(F.col("html"))).alias("body")
    return load(spark, folder, "pages").select("page_id", body)


@query(
    "normalise_name",
    "SELECT c_custkey, lower(c_name) AS folded, '  ' || upper(c_name) || ' ' AS display FROM customer",
)
def normalise_name(spark, folder):
    display = F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))
    return load(spark, folder, "customer").select(
        "c_custkey", text.normalise_name(display).alias("folded"), display.alias("display")
    )


@query(
    "token_estimate",
    r"""
    SELECT doc_id, trunc(len(regexp_split_to_array(text, '\s+')) * 1.3::DOUBLE)::INTEGER AS token_count
    FROM documents
    """,
)
def token_estimate(spark, folder):
    estimate = text.token_estimate(F.col("text")).alias("token_count")
    return load(spark, folder, "documents").select("doc_id", estimate)


@query(
    "chunk_build",
    r"""
    SELECT sha256(doc_id || '|' || n_chars || '|' || source) AS chunk_id, doc_id AS listing_id, 'rome' AS city,
           CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END AS neighbourhood,
           toxic::VARCHAR AS room_type, source AS review_date, text AS chunk_text,
           trunc(len(regexp_split_to_array(text, '\s+')) * 1.3::DOUBLE)::INTEGER AS token_count
    FROM documents LEFT JOIN labels USING (doc_id) WHERE length(text) > 0
    """,
)
def chunk_build(spark, folder):
    city = F.lit("rome").alias("city")
    reviews = load(spark, folder, "documents").select(
        F.col("doc_id").alias("listing_id"),
        F.col("n_chars").alias("reviewer_id"),
        F.col("source").alias("date"),
        F.col("text").alias("comments"),
        city,
    )
    listings = load(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        city,
        F.when(F.col("quality") == 1, "good")
        .when(F.col("quality") == 0, "poor")
        .alias("neighbourhood"),
        F.col("toxic").cast("string").alias("room_type"),
    )
    return chunks.build_chunks(reviews, listings)


@query(
    "id_normalise",
    "SELECT vec_id, vec_id::VARCHAR AS from_text, (vec_id + 9999990)::VARCHAR AS from_double FROM embeddings",
)
def id_normalise(spark, folder):
    padded = F.concat(F.lit("\u00a0 "), F.col("vec_id").cast("string"), F.lit("\n"))
    return load(spark, folder, "embeddings").select(
        "vec_id",
        values.id_normalise(padded).alias("from_text"),
        values.id_normalise((F.col("vec_id") + 9999990).cast("double")).alias("from_double"),
    )


@query(
    "context_view",
    """
    SELECT doc_id, lang AS neighbourhood, round_even(n_chars / 7.0::DOUBLE, 2) AS score,
           text[1:400] AS text FROM documents
    """,
)
def context_view(spark, folder):
    contexts = load(spark, folder, "documents").select(
        "doc_id",
        F.col("lang").alias("neighbourhood"),
        (F.col("n_chars") / F.lit(7.0)).alias("rerank_score"),
        F.col("text").alias("chunk_text"),
    )
    return prompts.context_view(contexts, "doc_id")


@query(
    "request_key",
    """
    SELECT event_id, lower(event_type) || ' ' || user_id || '|' || CASE
               WHEN event_type = 'error' THEN 'null'
               WHEN event_type = 'view' THEN '{"kind":"neighbourhood","neighbourhood":"eur"}'
               ELSE '{"kind":"listing","listing_id":' || user_id || '}' END AS request_key
    FROM events
    """,
)
def request_key(spark, folder):
    """Scopes carry different fields; a missing one leaves no trace in the key."""
    asked = F.concat(F.lit("\u00a0 \t"), F.upper("event_type"), F.lit(" "), F.col("user_id"), F.lit("\n"))
    kind = F.when(F.col("event_type") == "view", "neighbourhood").otherwise("listing")
    scope = F.when(
        F.col("event_type") != "error",
        F.struct(
            F.when(kind == "neighbourhood", "eur").alias("neighbourhood"),
            F.when(kind == "listing", F.col("user_id")).alias("listing_id"),
            kind.alias("kind"),
        ),
    )
    return load(spark, folder, "events").select(
        "event_id", values.request_key(asked, scope).alias("request_key")
    )


@query(
    "words",
    f"""
    SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs
    FROM (SELECT doc_id, unnest({WORDS.format("text")}) AS word FROM documents) GROUP BY word
    """,
)
def words(spark, folder):
    """Occurrences and texts per word.

    Both counts ride on one explode and are summed per word before the shuffle, so only
    the vocabulary of each task travels, not its (text, word) pairs.
    """
    split = utterances(spark, folder).select(text.words(F.col("text")).alias("w"))

    def marks(tokens, n, n_docs):
        return F.transform(
            tokens,
            lambda w: F.struct(w.alias("word"), F.lit(n).alias("n"), F.lit(n_docs).alias("n_docs")),
        )

    every = F.concat(marks(F.col("w"), 1, 0), marks(F.array_distinct("w"), 0, 1))
    counted = split.select(F.explode(every).alias("m")).groupBy("m.word")
    return counted.agg(F.sum("m.n").alias("n"), F.sum("m.n_docs").alias("n_docs"))


@query(
    "ngrams",
    f"WITH {_phrases_sql('benchmark', 'item_id', 'said')}"
    " SELECT id AS item_id, phrase, count(*) AS n FROM said GROUP BY ALL",
)
def ngrams(spark, folder):
    split = load(spark, folder, "benchmark").select("item_id", text.words(F.col("text")).alias("w"))
    found = split.select("item_id", F.explode(text.ngrams(F.col("w"))).alias("phrase"))
    return found.groupBy("item_id", "phrase").agg(F.count("*").alias("n"))


@query(
    "dcg_discount",
    """
    SELECT l_linenumber, count(*) AS n, round(avg(1.0::DOUBLE / log2(l_linenumber + 1)), 6) AS discount
    FROM lineitem GROUP BY l_linenumber
    """,
)
def dcg_discount(spark, folder):
    discount = evaluation.dcg_discount(F.col("l_linenumber"))
    return load(spark, folder, "lineitem").groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.round(F.avg(discount), 6).alias("discount")
    )


LANGUAGE_HITS = ", ".join(
    "len(list_filter(tk, lambda w: w IN ({}))) AS {}".format(
        ", ".join(f"'{w}'" for w in vocabulary.split()), lang
    )
    for lang, vocabulary in STOP_WORDS.items()
)
LANGUAGE_CASE = " ".join(f"WHEN {lang} = best THEN '{lang}'" for lang in STOP_WORDS)


@query(
    "detect_language",
    rf"""
    WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\p{{L}}+') AS tk FROM documents),
    h AS (SELECT doc_id, text, {LANGUAGE_HITS} FROM t),
    b AS (SELECT *, greatest({", ".join(STOP_WORDS)}) AS best FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 12 OR best = 0 THEN 'unknown' {LANGUAGE_CASE} END AS detected
    FROM b
    """,
)
def detect_language(spark, folder):
    return with_language(utterances(spark, folder), "text", "detected").select("doc_id", "detected")


# Questions appended to real turns, so that every label occurs.
SAMPLES = [
    "Prezzo medio in centro?",
    "Com'è la zona, è tranquilla?",
    "Quante camere ci sono?",
    "Cosa dicono le recensioni?",
    "rumore di notte",
    "How many listings are there",
    "Is it CLEAN?",
    "ciao, grazie",
    "quanto costa dormire qui",
]
SAMPLES_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SAMPLES) + "]"
TURNS_SQL = f"""
    turns AS (SELECT conv_id, turn, text || ' ' || ({SAMPLES_SQL})[(conv_id + turn) % {len(SAMPLES)} + 1] AS q
              FROM conversations)
"""


def turns(spark, folder):
    at = (F.col("conv_id") + F.col("turn")) % len(SAMPLES) + 1
    sample = F.element_at(F.array(*[F.lit(s) for s in SAMPLES]), at.cast("int"))
    return load(spark, folder, "conversations").select(
        "conv_id", "turn", F.concat("text", F.lit(" "), sample).alias("q")
    )


def _any_of(phrases, column: str) -> str:
    body = "|".join(phrases).replace("'", "''")
    return (
        rf"regexp_matches(lower({column}), '(^|[^\p{{L}}\p{{N}}_])({body})($|[^\p{{L}}\p{{N}}_])')"
    )


def _label_sql(column: str) -> str:
    return (
        f"CASE WHEN {_any_of(intents.ANALYTICS_PHRASES, column)} THEN 'analytics'"
        f" WHEN {_any_of(intents.REVIEW_PHRASES, column)} THEN 'rag' ELSE 'conversational' END"
    )


def _override_sql(intent: str, column: str, scoped: str) -> str:
    stems = "|".join(intents.SCOPED_ANALYTICS_STEMS)
    return f"CASE WHEN {scoped} AND NOT regexp_matches(lower({column}), '{stems}') THEN 'rag' ELSE {intent} END"


@query("intent_label", f"WITH {TURNS_SQL} SELECT conv_id, turn, {_label_sql('q')} AS intent FROM turns")
def intent_label(spark, folder):
    return turns(spark, folder).select("conv_id", "turn", intents.intent_label(F.col("q")).alias("intent"))


@query(
    "intent_from_json",
    f"""
    WITH {TURNS_SQL}
    SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'rag' WHEN 1 THEN 'analytics'
                          ELSE {_label_sql("q")} END AS intent
    FROM turns
    """,
)
def intent_from_json(spark, folder):
    """Replies of four forms by turn: clean, chatty, unknown label, no JSON."""
    form = F.col("turn") % 4
    raw = (
        F.when(form == 0, '{"intent": "rag"}')
        .when(form == 1, 'Sure: {"intent" :"analytics"} done')
        .when(form == 2, '{"intent": "other"}')
        .otherwise(F.concat(F.lit("analytics? "), "q"))
    )
    label = intents.intent_from_json(raw, F.col("q")).alias("intent")
    return turns(spark, folder).select("conv_id", "turn", label)


@query(
    "scope_override",
    f"""
    WITH {TURNS_SQL}
    SELECT conv_id, turn, {_override_sql(_label_sql("q"), "q", "turn % 2 = 0")} AS intent FROM turns
    """,
)
def scope_override(spark, folder):
    query_text = F.col("q")
    label = intents.scope_override(intents.intent_label(query_text), query_text, F.col("turn") % 2 == 0)
    return turns(spark, folder).select("conv_id", "turn", label.alias("intent"))


@query(
    "scope_resolve",
    f"""
    WITH q AS (SELECT doc_id, lang, source, text || ' ' || ({SAMPLES_SQL})[doc_id % {len(SAMPLES)} + 1] AS text
               FROM documents),
    {place_match_sql("q")}, {name_match_sql("q")},
    s AS (SELECT doc_id, source, CASE WHEN lang = 'fr' THEN 'listing' WHEN lang = 'de' THEN 'neighbourhood'
                 END AS kind, text FROM q),
    i AS (SELECT doc_id, source, kind, {_override_sql(_label_sql("text"), "text", "kind IS NOT NULL")} AS intent
          FROM s),
    r AS (SELECT doc_id, intent,
                 CASE WHEN intent = 'rag' AND kind = 'listing' THEN doc_id
                      WHEN intent = 'rag' AND kind IS NULL AND place IS NULL THEN listing_id END AS listing_id,
                 CASE WHEN intent = 'rag' AND kind = 'neighbourhood' THEN source
                      WHEN intent = 'rag' AND kind IS NULL THEN place END AS neighbourhood
          FROM i LEFT JOIN place_match USING (doc_id) LEFT JOIN name_match USING (doc_id))
    SELECT doc_id AS question_id, intent, listing_id, neighbourhood,
           CASE WHEN intent <> 'rag' THEN intent WHEN listing_id IS NOT NULL THEN 'listing'
                WHEN neighbourhood IS NOT NULL THEN 'place' ELSE 'clarify' END AS route
    FROM r
    """,
)
def scope_resolve(spark, folder):
    """Documents as questions: French ones scoped to a listing, German ones to a place."""
    docs = load(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    sample = F.element_at(
        F.array(*[F.lit(s) for s in SAMPLES]), (F.col("doc_id") % len(SAMPLES) + 1).cast("int")
    )
    said = F.concat("text", F.lit(" "), sample)
    kind = F.when(F.col("lang") == "fr", "listing").when(F.col("lang") == "de", "neighbourhood")
    scope = F.when(
        kind.isNotNull(),
        F.struct(
            kind.alias("kind"),
            F.col("doc_id").alias("listing_id"),
            F.col("source").alias("neighbourhood"),
            F.lit("scoped").alias("label"),
        ),
    )
    questions = spread_few_splits(docs, "doc_id").select(
        F.col("doc_id").alias("question_id"),
        said.alias("text"),
        intents.intent_label(said).alias("intent"),
        scope.alias("scope"),
    )
    items = load(spark, folder, "benchmark").select(
        F.col("item_id").alias("listing_id"), F.col("text").alias("listing_name")
    )
    routed = routing.resolve_scopes(questions, word_places(spark, folder), items)
    return routed.select("question_id", "intent", "listing_id", "neighbourhood", "route")


STATEMENT_FORMS = [
    "SELECT avg(price) FROM t WHERE name ILIKE '%{}%'",
    "```sql\nselect * from t where name = '{}';\n```",
    "WITH a AS (SELECT '{}' AS x) SELECT x FROM a;;",
    "(SELECT '{}')",
    "( select '{}')",
    "SELECT 1; DROP TABLE \"{}\"",
    "DELETE FROM t WHERE name = '{}'",
    "SELECT replace(name, '{}', '') FROM t",
    "SELECT 'offset_{}', settings FROM t",
    "  ```  ",
]


def _verdicts() -> str:
    """What each form must yield, worked out by hand."""
    return (
        "['ok', 'ok', 'ok', 'ok', 'not_select', 'multiple', 'not_select', 'forbidden_word', 'ok', 'empty']"
    )


def _clean(form: int, name: str) -> str:
    bare = {
        0: STATEMENT_FORMS[0],
        1: "select * from t where name = '{}'",
        2: "WITH a AS (SELECT '{}' AS x) SELECT x FROM a",
        3: STATEMENT_FORMS[3],
        8: STATEMENT_FORMS[8],
    }[form]
    head, tail = bare.replace("'", "''").split("{}")
    return f"'{head}' || {name} || '{tail}'"


@query(
    "sql_audit",
    f"""
    SELECT p_partkey, ({_verdicts()})[p_partkey % 10 + 1] AS verdict,
           CASE p_partkey % 10 {" ".join(f"WHEN {i} THEN {_clean(i, 'p_name')}" for i in (0, 1, 2, 3, 8))}
           END AS clean_sql
    FROM part
    """,
)
def sql_audit(spark, folder):
    forms = F.array(*[F.lit(s) for s in STATEMENT_FORMS])
    form = F.element_at(forms, (F.col("p_partkey") % len(STATEMENT_FORMS) + 1).cast("int"))
    statements = load(spark, folder, "part").select(
        "p_partkey", F.replace(form, F.lit("{}"), F.col("p_name")).alias("statement")
    )
    return routing.audit_statements(statements).select("p_partkey", "verdict", "clean_sql")


# Judge replies by quality and toxicity label; scores outside 1 to 5 do not count.
JUDGED_SQL = """
    judged AS (SELECT doc_id, CASE quality WHEN 1 THEN 4 WHEN 0 THEN 1 END AS faithfulness,
                      CASE WHEN toxic = 0 THEN 5 END AS relevance
               FROM documents LEFT JOIN labels USING (doc_id))
"""


def judged(spark, folder):
    docs = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id", "left")
    first = F.when(F.col("quality") == 1, 4).otherwise(1)
    second = F.when(F.col("toxic") == 0, 5).otherwise(9)
    raw = F.when(F.col("quality").isNull(), "no verdict").otherwise(
        F.concat(
            F.lit('Scores:\n{"faithfulness" : '), first, F.lit(', "relevance": '), second, F.lit("}")
        )
    )
    return docs.select("doc_id", raw.alias("raw"))


@query("judge_scores", f"WITH {JUDGED_SQL} SELECT doc_id, faithfulness, relevance FROM judged")
def judge_scores(spark, folder):
    scored = evaluation.judge_scores(judged(spark, folder))
    return scored.select("doc_id", "faithfulness", "relevance")


@query(
    "judge_summary",
    f"""
    WITH {JUDGED_SQL}
    SELECT round_even(avg(faithfulness), 3) AS avg_faithfulness,
           round_even(avg(relevance), 3) AS avg_relevance, count(*) AS n FROM judged
    """,
)
def judge_summary(spark, folder):
    return evaluation.judge_summary(judged(spark, folder))


@query(
    "response_text",
    r"""
    SELECT conv_id, turn, CASE (conv_id + turn) % 6
        WHEN 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g')
        WHEN 1 THEN regexp_replace(text || role, '^\s+|\s+$', '', 'g')
        WHEN 2 THEN regexp_replace(role || ' ' || text, '^\s+|\s+$', '', 'g')
        WHEN 3 THEN regexp_replace(text, '^\s+|\s+$', '', 'g')
        WHEN 4 THEN '' END AS answer
    FROM conversations
    """,
)
def response_text(spark, folder):
    """Logged replies of six forms: text, parts, reasoning only, prediction, empty, broken."""

    def part(kind, body):
        return F.struct(F.lit(kind).alias("type"), body.alias("text"))

    def thought(*bodies):
        summary = F.array(*[F.struct(b.alias("text")) for b in bodies])
        return F.struct(F.lit("reasoning").alias("type"), summary.alias("summary"))

    def chat(content):
        message = F.struct(F.struct(content.alias("content")).alias("message"))
        return F.to_json(F.struct(F.array(message).alias("choices")))

    said, role = F.col("text"), F.col("role")
    reasoning = F.to_json(thought(F.lit("hidden")))
    parts = F.concat(
        F.lit('{"choices":[{"message":{"content":['),
        reasoning,
        F.lit(","),
        F.to_json(part("text", said)),
        F.lit(","),
        F.to_json(part("output_text", role)),
        F.lit("]}}]}"),
    )
    candidate = F.struct(F.array(F.struct(said.alias("text"))).alias("candidates"))
    form = (F.col("conv_id") + F.col("turn")) % 6
    reply = (
        F.when(form == 0, chat(F.concat(F.lit("\n "), said)))
        .when(form == 1, parts)
        .when(form == 2, chat(F.array(thought(role, said))))
        .when(form == 3, F.to_json(F.struct(F.array(candidate).alias("predictions"))))
        .when(form == 4, '{"choices":[{"message":{"role":"assistant"}}]}')
        .otherwise(F.concat(F.lit('{"oops": '), said))
    )
    logged = load(spark, folder, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return with_response_text(logged, "reply").select("conv_id", "turn", "answer")


@query(
    "delta_concat",
    """
    SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer, count(*) AS n_pieces
    FROM conversations WHERE role <> 'system' AND length(text) > 0 GROUP BY conv_id
    """,
)
def delta_concat(spark, folder):
    """Turns as streamed events: user text as a string, assistant text as parts, system hidden."""

    def event(content):
        delta = F.struct(F.struct(content.alias("content")).alias("delta"))
        return F.to_json(F.struct(F.array(delta).alias("choices")))

    kind = F.when(F.col("role") == "system", "reasoning").otherwise("text")
    parts = F.array(F.struct(kind.alias("type"), F.col("text").alias("text")))
    payload = F.when(F.col("role") == "user", event(F.col("text"))).otherwise(event(parts))
    events = load(spark, folder, "conversations").select("conv_id", "turn", payload.alias("payload"))
    return prompts.join_deltas(events, "conv_id", "turn", "payload")
