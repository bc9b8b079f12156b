"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for IBANs, byte
ranges for addresses, digit counts for phones), words near a span adjust its score and a span
counts from ``THRESHOLD`` on. E-mail addresses, IP addresses, cards and phones start above it.

A possessive group never steps back and a look-behind (or the end of the match before) keeps a
pattern from starting again inside a run it has failed on, so long runs take linear time. Spark
has no function for the places of matches: the text is split at the pattern, and a match starts
after the lengths of all that precedes it, summed in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the result. The first four have fixed definitions.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Cheap tests that every text with a match passes.
HINTS = {"email": "@", "phone": "+"}
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account)\b",
    "ssn": r"(?i)\b(?:ssn|social security|tax id)\b",
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
THRESHOLD = 0.6
_BLOCK = 64


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once per row."""
    return F.transform(F.array(value), use)[0]


def starts(lengths: Column) -> Column:
    """Sums of all elements before each one, in blocks: linear but for a square of the blocks."""
    blocks = F.sequence(F.lit(0), F.ceil(F.size(lengths) / _BLOCK).cast("int") - 1)
    add = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)

    def of_block(sums: Column) -> Callable[[Column], Column]:
        def inner(b: Column) -> Column:
            part = F.slice(lengths, b * _BLOCK + 1, _BLOCK)
            base = add(F.slice(sums, F.lit(1), b))
            return bind(base, lambda at: F.transform(part, lambda _, i: at + add(F.slice(part, F.lit(1), i))))

        return inner

    return bind(
        F.transform(blocks, lambda b: add(F.slice(lengths, b * _BLOCK + 1, _BLOCK))),
        lambda sums: F.flatten(F.transform(blocks, of_block(sums))),
    )


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
        value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        rest = F.aggregate(
            F.split(turned, ""), F.lit(0), lambda s, c: (s * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97
        )
        return (F.length(plain) >= 15) & (rest == 1)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array of (start, nth, end, score), code points, end exclusive."""
    pattern = PATTERNS[kind]
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, nth: INT, end: BIGINT, score: DOUBLE>>)")

    def located(hits: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            lengths = F.transform(hits, lambda h, i: (F.length(gaps[i]) + F.length(h)).cast("long"))
            return bind(lengths, lambda ls: F.zip_with(hits, bind(ls, starts), lambda h, s: F.struct(h.alias("h"), s.alias("s"))))

        def near(gaps: Column) -> Column:
            return bind(
                with_gaps(gaps),
                lambda found: F.transform(
                    found,
                    lambda f, i: F.struct(
                        (f.s + F.length(gaps[i])).cast("long").alias("start"),
                        F.lit(KINDS.index(kind)).alias("nth"),
                        (f.s + F.length(gaps[i]) + F.length(f.h)).cast("long").alias("end"),
                        (
                            F.lit(BASE_SCORE[kind])
                            + F.when(
                                F.concat_ws(
                                    " ", F.right(gaps[i], F.lit(CONTEXT_CHARS)), F.left(gaps[i + 1], F.lit(CONTEXT_CHARS))
                                ).rlike(CONTEXT[kind]),
                                F.lit(CONTEXT_BONUS),
                            ).otherwise(F.lit(0.0))
                        ).alias("score"),
                        _valid(kind, f.h).alias("ok"),
                    ),
                ),
            )

        scored = bind(F.split(text, pattern, -1), near)
        kept = F.filter(scored, lambda x: x.ok & (x.score >= THRESHOLD))
        return F.transform(kept, lambda x: F.struct(x.start, x.nth, x.end, F.least(x.score, F.lit(1.0)).alias("score")))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = bind(hits, lambda h: F.when(F.size(h) > 0, located(h)).otherwise(empty))
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
    return F.when(hint, found).otherwise(empty)


def _listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x.nth), x.start, x.end)), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of the base kinds, digest and list of spans.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the spans of these kinds),
    spans (all kinds, "kind:start:end" by start and kind, joined by commas), n_other and max_score
    (null without spans). A null text counts as empty; a null doc_id is kept; repeated rows give
    repeated results. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [spans(text, kind).alias(f"_{kind}") for kind in KINDS]
    base = docs.select("doc_id", *kinds)

    def result(every: Column) -> Column:
        first = F.filter(every, lambda x: x.nth < 4)
        count = lambda n: F.size(F.filter(every, lambda x: x.nth == n)).cast("long")
        return F.struct(
            *(count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])),
            F.sha2(_listed(first).cast("binary"), 256).alias("base_sha256"),
            _listed(every).alias("spans"),
            F.size(F.filter(every, lambda x: x.nth >= 4)).cast("long").alias("n_other"),
            F.array_max(F.transform(every, lambda x: x.score)).alias("max_score"),
        )

    every = F.array_sort(F.concat(*(F.col(f"_{kind}") for kind in KINDS)))
    return base.select("doc_id", bind(every, result).alias("_r")).select("doc_id", "_r.*")


def redacted(text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans give one after another.

    Null stays null.
    """
    names = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))
    none = F.expr("named_struct('at', 0L, 'pieces', CAST(array() AS ARRAY<STRUCT<from: BIGINT, to: BIGINT, nth: INT>>))")

    def step(state: Column, x: Column) -> Column:
        piece = F.struct(state["at"].alias("from"), F.greatest(x.start, state["at"]).alias("to"), x.nth.alias("nth"))
        grown = F.struct(x.end.alias("at"), F.concat(state["pieces"], F.array(piece)).alias("pieces"))
        return F.when(x.end <= state["at"], state).otherwise(grown)

    def rebuilt(state: Column) -> Column:
        before = F.transform(
            state["pieces"],
            lambda p: F.concat(
                F.substr(text, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")), F.get(names, p["nth"])
            ),
        )
        return F.concat(F.array_join(before, ""), F.substr(text, (state["at"] + 1).cast("int")))

    def with_spans(every: Column) -> Column:
        merged = F.aggregate(every, none, step)
        return F.when(F.size(every) == 0, text).otherwise(bind(merged, rebuilt))

    plain = F.coalesce(text, F.lit(""))
    every = F.array_sort(F.concat(*(spans(plain, kind) for kind in KINDS)))
    return F.when(text.isNotNull(), bind(every, with_spans))
