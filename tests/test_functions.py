"""Column expressions on hand-made edge rows."""

import json

import pytest
from pyspark.sql import functions as F

from lodgelens.functions import intents, text, values
from lodgelens.functions.language import with_language
from lodgelens.functions.replies import delta_text, judge_score, with_response_text
from lodgelens.operators.routing import audit_statements


def one(spark, value, make, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, price",
    [
        ("$1,234.00", 1234.0),
        ("$9.99", None),
        ("10", 10.0),
        ("5000", 5000.0),
        ("5000.01", None),
        ("", None),
        (None, None),
        ("abc", None),
    ],
)
def test_price(spark, raw, price):
    assert one(spark, raw, lambda c: values.range_to_null(values.parse_price(c))) == price


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("<b>Nice</b>  place<br/>near\nthe\t park ", "Nice place near the park"),
        ("a &amp; b", "a &amp; b"),
        (" x ", " x "),
        (" \t\n ", ""),
        ("a < b > c", "a c"),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, lambda c: text.squash_space(text.strip_tags(c))) == clean


@pytest.mark.parametrize(
    "raw, n", [("one two three", 3), ("one", 1), ("a b c d e f g h i j", 13), ("", 1)]
)
def test_token_estimate(spark, raw, n):
    assert one(spark, raw, text.token_estimate) == n


@pytest.mark.parametrize(
    "raw, norm",
    [(" 123.0 ", "123"), ("123", "123"), ("9007199254740993", "9007199254740993"), ("1.00", "1.00")],
)
def test_id_normalise(spark, raw, norm):
    assert one(spark, raw, values.id_normalise) == norm


def test_ngrams_drop_common_only(spark):
    df = spark.createDataFrame([("La Casa di Anna a Roma",), ("casa",), ("",), (None,)], "t string")
    got = df.select(text.words(F.col("t")).alias("w")).select(text.ngrams(F.col("w")).alias("g"))
    phrases = [r["g"] for r in got.collect()]
    assert "di anna" in phrases[0] and "la casa di anna" in phrases[0]
    assert "la casa" not in phrases[0] and "a roma" not in phrases[0]
    assert phrases[1:3] == [[], []]


@pytest.mark.parametrize(
    "said, label",
    [
        ("Qual è il prezzo medio per tipo di stanza?", "analytics"),
        ("Quanti host hanno tante case?", "analytics"),
        ("com'è bello", "rag"),
        ("com'èx bello", "conversational"),
        ("Gli ospiti parlano del RUMORE?", "rag"),
        ("Cosa dicono le recensioni?", "conversational"),
        ("minimo_x", "conversational"),
        ("ciao", "conversational"),
        ("", "conversational"),
    ],
)
def test_intent_label(spark, said, label):
    assert one(spark, said, intents.intent_label) == label


def test_inflected_stems(spark):
    said = "Cosa dicono le recensioni?"
    assert one(spark, said, lambda c: intents.intent_label(c, inflected=True)) == "rag"


@pytest.mark.parametrize(
    "raw, label",
    [
        ('{"intent": "rag"}', "rag"),
        ('thinking... {"intent":"analytics"}', "analytics"),
        ('{"intent": "poetry"}', "conversational"),
        ("rag", "conversational"),
        (None, "conversational"),
    ],
)
def test_intent_from_json(spark, raw, label):
    assert one(spark, raw, lambda c: intents.intent_from_json(c, F.lit("ciao"))) == label


@pytest.mark.parametrize(
    "said, scoped, label",
    [
        ("è pulito?", True, "rag"),
        ("è pulito?", False, "conversational"),
        ("quante notti?", True, "conversational"),
        ("PIÙ CARO", True, "conversational"),
    ],
)
def test_scope_override(spark, said, scoped, label):
    got = one(
        spark, said, lambda c: intents.scope_override(F.lit("conversational"), c, F.lit(scoped))
    )
    assert got == label


@pytest.mark.parametrize(
    "sql, verdict, clean",
    [
        ("```sql\nSELECT 1;\n```", "ok", "SELECT 1"),
        ("select 1;;", "ok", "select 1"),
        ("select 1; ;", "multiple", None),
        ("select 1; select 2", "multiple", None),
        ("WITH a AS (SELECT 1) SELECT * FROM a", "ok", "WITH a AS (SELECT 1) SELECT * FROM a"),
        ("((SELECT 1))", "ok", "((SELECT 1))"),
        ("( select 1)", "not_select", None),
        ("drop table t", "not_select", None),
        ("select replace(a, 'x', 'y') from t", "forbidden_word", None),
        ("select 'please DELETE me'", "forbidden_word", None),
        ("select updated_at, offset_set from t", "ok", "select updated_at, offset_set from t"),
        ("  ", "empty", None),
        ("```", "empty", None),
        (None, "empty", None),
    ],
)
def test_sql_audit(spark, sql, verdict, clean):
    row = audit_statements(spark.createDataFrame([(sql,)], "statement string")).first()
    assert (row["verdict"], row["clean_sql"]) == (verdict, clean)


def chat(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


THOUGHT = {"type": "reasoning", "summary": [{"text": "first"}, {"text": ""}, {"text": "then"}]}


@pytest.mark.parametrize(
    "reply, answer",
    [
        (chat("  hello\n"), "hello"),
        (chat([THOUGHT, {"type": "text", "text": "a"}, {"type": "output_text", "text": "b"}]), "ab"),
        (chat([THOUGHT]), "first then"),
        (chat([THOUGHT, {"type": "text", "text": ""}]), "first then"),
        (chat(["plain", {"type": "image", "text": "no"}]), "plain"),
        (chat([]), ""),
        (chat(5), "5"),
        (chat(None), "None"),
        (json.dumps({"choices": [{"message": {}}]}), ""),
        (json.dumps({"choices": [{"text": "old form"}]}), "old form"),
        (json.dumps({"predictions": [{"candidates": [{"text": "p"}]}]}), "p"),
        (json.dumps({"predictions": ["bare"]}), "bare"),
        (json.dumps({"error": 1}), None),
        ("not json", None),
        (None, None),
    ],
)
def test_response_text(spark, reply, answer):
    df = spark.createDataFrame([(reply,)], "r string")
    assert with_response_text(df, "r").first()["answer"] == answer


@pytest.mark.parametrize(
    "content, piece",
    [
        ("ab ", "ab "),
        ([{"type": "text", "text": "x"}, {"type": "reasoning", "text": "y"}], "x"),
        (None, ""),
        (7, ""),
    ],
)
def test_delta_text(spark, content, piece):
    event = json.dumps({"choices": [{"delta": {"content": content}}]})
    assert one(spark, event, lambda c: delta_text(F.try_parse_json(c))) == piece


@pytest.mark.parametrize(
    "raw, score",
    [
        ('{"faithfulness": 5, "relevance": 1}', 5),
        ('"faithfulness" :3', 3),
        ('{"faithfulness": 0}', None),
        ('{"faithfulness": 6}', None),
        ("no", None),
        (None, None),
    ],
)
def test_judge_score(spark, raw, score):
    assert one(spark, raw, lambda c: judge_score(c, "faithfulness")) == score


@pytest.mark.parametrize(
    "said, lang",
    [
        ("the flat was very nice and clean", "en"),
        ("la casa è molto bella e il letto è comodo", "it"),
        ("die Wohnung ist sehr schön und ruhig", "de"),
        ("l'appartement est très calme et dans une rue", "fr"),
        ("el piso es muy bonito y los vecinos", "es"),
        ("the and of it", "en"),
        ("the of and it", "en"),
        ("the and nice", "unknown"),
        ("zzz qqq xxx www", "unknown"),
        (None, "unknown"),
    ],
)
def test_language(spark, said, lang):
    df = spark.createDataFrame([(said,)], "t string")
    assert with_language(df, "t").first()["lang"] == lang


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang")
    judged = with_language(docs, "text", "guess").filter("guess <> 'unknown'")
    right = judged.groupBy("lang").agg(F.avg((F.col("guess") == F.col("lang")).cast("double")).alias("p"))
    assert all(r["p"] > 0.9 for r in right.collect()), right.collect()


def test_detector_plug_in(spark):
    df = spark.createDataFrame([("a text that is long",), ("short",), (None,)], "t string")

    def detector(batch):
        return batch.map(lambda _: "xx")

    got = with_language(df, "t", detector=detector).select("lang").collect()
    assert [r["lang"] for r in got] == ["xx", "unknown", "unknown"]


def test_request_key(spark):
    df = spark.createDataFrame(
        [(" Ciao\n", None), ("ciao", ("listing", 5))],
        "q string, s struct<kind: string, listing_id: bigint>",
    )
    got = [r[0] for r in df.select(values.request_key(F.col("q"), F.col("s"))).collect()]
    assert got == ["ciao|null", 'ciao|{"kind":"listing","listing_id":5}']
