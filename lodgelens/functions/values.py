"""Money, ids, keys and order columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgelens.functions.text import strip_space

# Prices outside this closed range count as junk.
PRICE_MIN, PRICE_MAX = 10.0, 5000.0


def parse_price(c: Column) -> Column:
    """``$1,234.00`` to 1234.0; text that is no number becomes null."""
    return F.regexp_replace(c.cast("string"), "[$,]", "").try_cast("double")


def range_to_null(c: Column, low: float = PRICE_MIN, high: float = PRICE_MAX) -> Column:
    return F.when(c.between(low, high), c)


def id_normalise(c: Column) -> Column:
    """Id as text without white space around it and without a trailing ``.0``.

    Whole numbers of a fractional type are written out: as text, large doubles have an exponent.
    """
    whole = c.try_cast("decimal(38,0)")
    integral = F.typeof(c).rlike("^(?:double|float|decimal)") & (whole.cast("double") == c.try_cast("double"))
    plain = F.regexp_replace(strip_space(c.cast("string")), r"\.0$", "")
    return F.when(integral, whole.cast("string")).otherwise(plain)


def stable_key(*parts: Column) -> Column:
    """Hex key that is the same on every run for the same parts."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def request_key(query: Column, scope: Column) -> Column:
    """Cache key of a request: folded query text and the scope as JSON with sorted keys.

    A variant keeps the keys of an object in order, whatever the order of the scope's fields.
    """
    scope_text = F.coalesce(F.to_json(F.parse_json(F.to_json(scope))), F.lit("null"))
    return F.concat(F.lower(strip_space(query)), F.lit("|"), scope_text)


def event_order(ts: Column, event_id: Column) -> Column:
    """One number that sorts like (ts, id).

    A struct would sort alike, but Spark keeps structs out of hash aggregation and
    sorts the whole input first; a decimal stays in the fixed-width buffer.
    """
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(17,0)")
    step = F.lit("10000000000000000000").cast("decimal(20,0)")
    return micros * step + event_id.cast("decimal(19,0)")


def distinctive_place_token(token: Column) -> Column:
    """Tokens of a place name that identify it: four letters or more, or a known short name."""
    # Fixed value: short place names that still count.
    return (F.length(token) >= 4) | token.isin("eur")
