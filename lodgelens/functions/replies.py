"""Answer text, streamed pieces and judge scores out of logged model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.once import with_once
from lodgelens.functions.text import strip_space

# Part types that carry answer text.
ANSWER_PARTS = ["text", "output_text"]


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _part_text(part: Column) -> Column:
    """Text an answer part contributes; null if it contributes none."""
    text = F.nullif(_get(part, "$.text"), F.lit(""))
    typed = F.when(_get(part, "$.type").isin(ANSWER_PARTS), text)
    return F.when(_is_object(part), typed).otherwise(_get(part, "$"))


def _reasoning_texts(part: Column) -> Column:
    summary = F.coalesce(
        F.when(_get(part, "$.type") == "reasoning", _get(part, "$.summary", "array<variant>")),
        F.array().cast("array<variant>"),
    )
    return F.transform(summary, lambda s: F.nullif(_get(s, "$.text"), F.lit("")))


def _content_text(content: Column) -> Column:
    """A string as it is; of a list the answer parts, or the reasoning if that is all."""
    parts = _get(content, "$", "array<variant>")
    answer = F.array_compact(F.transform(parts, _part_text))
    reasoning = F.array_compact(F.flatten(F.transform(parts, _reasoning_texts)))
    listed = F.when(F.size(answer) > 0, F.array_join(answer, "")).otherwise(
        F.array_join(reasoning, " ")
    )
    # A null content prints as the word None in the logs this reads.
    plain = F.when(F.is_variant_null(content), "None").otherwise(_get(content, "$"))
    return F.when(parts.isNotNull(), listed).otherwise(plain)


def response_text(doc: Column) -> Column:
    """Answer text of a parsed chat response (variant); null if the form is unknown."""
    message = _get(doc, "$.choices[0].message", "variant")
    content = _get(doc, "$.choices[0].message.content", "variant")
    first = _get(doc, "$.predictions[0]", "variant")
    prediction = F.coalesce(_get(first, "$.candidates[0].text"), _get(first, "$"))
    text = (
        F.when(message.isNotNull() & content.isNull(), "")
        .when(message.isNotNull(), _content_text(content))
        .otherwise(F.coalesce(_get(doc, "$.choices[0].text"), prediction))
    )
    return strip_space(text)


def delta_text(doc: Column) -> Column:
    """Answer text of one parsed stream event (variant); empty for anything else."""
    content = _get(doc, "$.choices[0].delta.content", "variant")
    parts = _get(content, "$", "array<variant>")
    texts = F.transform(
        parts, lambda p: F.when(_get(p, "$.type").isin(ANSWER_PARTS), _get(p, "$.text"))
    )
    listed = F.array_join(F.array_compact(texts), "")
    plain = F.when(F.schema_of_variant(content) == "STRING", _get(content, "$"))
    return F.coalesce(F.when(parts.isNotNull(), listed).otherwise(plain), F.lit(""))


def with_response_text(df: DataFrame, response: str, out: str = "answer") -> DataFrame:
    """Add the answer text of a JSON text column; each reply is parsed once."""
    parsed = df.withColumn("_doc", F.try_parse_json(response))
    return with_once(parsed, {out: response_text(F.col("_doc"))}).drop("_doc")


def judge_score(raw: Column, name: str) -> Column:
    """Score 1 to 5 named ``name`` in a judge's reply; null if there is none."""
    return F.regexp_extract(raw, f'"{name}"\\s*:\\s*([1-5])', 1).try_cast("int")
