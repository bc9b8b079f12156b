"""Licence texts found by the digest of a canonical form, with DataFrame functions only.

A text is lower-cased, its copyright notices go, equivalent spellings become one, everything but letters
and digits becomes a single space, and the whole result is hashed. Known licences go through the same
expressions, so their digests follow any change of the rules. Whole documents are matched, and so is
each line that names a licence.

A notice starts a line (or follows a licence's title in it) with "copyright", "(c)" or "©" and has a
year, "(c)" or "©"; it ends with its line or where a known text opens. So the words "copyright notice"
inside a licence stay, however its lines are wrapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.llm.license_texts import LICENSES, SPELLINGS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Line ends of any kind become one.
ENDS, END = "\r\u0085\u2028\u2029", "\n\n\n\n"
#: A known text opens here, whatever stands before it in the line.
OPENING = (
    r"(permission[^a-z]+is[^a-z]+hereby[^a-z]+granted|permission[^a-z]+to[^a-z]+use[^a-z]+copy|redistribution[^a-z]+and[^a-z]+use"
    r"|this[^a-z]+software[^a-z]+is[^a-z]+provided|(?:licen[sc]ed|released)[^a-z]+under)"
)
#: A title in front of a notice in one line.
TITLE = r"(licen[sc]e(?: \(mit\))?)[ \t]+(copyright|\(c\)|©)"
#: A line that is a notice, with the line end before it.
NOTICE = (
    r"\n[ \t#*/;-]*(?:copyright[^\n]*(?:\(c\)|©|(?:19|20)[0-9][0-9])[^\n]*"
    r"|\(c\)[ \t]*(?:19|20)[0-9][0-9][^\n]*|©[^\n]*|all rights reserved[ \t.]*)"
)
#: Every known one-line notice has this in its lower-cased text.
NOTICE_HINT = "licen"


def canonical(text: Column) -> Column:
    """The form that is hashed."""
    plain = F.concat(F.lit("\n"), F.translate(text, UPPER + ENDS, LOWER + END))
    plain = F.regexp_replace(plain, OPENING, "\n$1")
    plain = F.regexp_replace(plain, TITLE, "$1\n$2")
    plain = F.regexp_replace(plain, NOTICE, "\n")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    spaced = F.concat(F.lit(" "), plain, F.lit(" "))
    for variant, word in SPELLINGS:
        spaced = F.replace(spaced, F.lit(f" {variant} "), F.lit(f" {word} "))
    return F.trim(spaced)


def canonical_sql(text: str) -> str:
    """The same form as a DuckDB expression."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    ends = " || ".join(f"chr({ord(c)})" for c in ENDS)
    plain = f"chr(10) || translate({text}, '{UPPER}' || {ends}, '{LOWER}' || repeat(chr(10), {len(END)}))"
    plain = f"regexp_replace({plain}, {quoted(OPENING)}, chr(10) || '\\1', 'g')"
    plain = f"regexp_replace({plain}, {quoted(TITLE)}, '\\1' || chr(10) || '\\2', 'g')"
    plain = f"regexp_replace({plain}, {quoted(NOTICE)}, chr(10), 'g')"
    spaced = f"' ' || trim(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for variant, word in SPELLINGS:
        spaced = f"replace({spaced}, ' {variant} ', ' {word} ')"
    return f"trim({spaced})"


def scan_sql(known=LICENSES) -> str:
    """``scan_licenses`` over the table documents, as DuckDB SQL."""
    values = ", ".join("('" + k.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for k, t in known)
    return f"""WITH known AS (SELECT sha256({canonical_sql("t")}) AS digest, min(k) AS license_id FROM (VALUES {values}) v(k, t) GROUP BY ALL),
rows AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM rows),
hits AS (SELECT DISTINCT id, license_id FROM lines JOIN known ON digest = sha256({canonical_sql("line")})
  WHERE contains(translate(line, '{UPPER}', '{LOWER}'), '{NOTICE_HINT}')),
notes AS (SELECT id, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM hits GROUP BY id),
hashed AS (SELECT id, doc_id, sha256({canonical_sql("text")}) AS canonical_sha256 FROM rows)
SELECT doc_id, canonical_sha256, k.license_id, coalesce(notices, '') AS notices
FROM hashed LEFT JOIN known k ON digest = canonical_sha256 LEFT JOIN notes USING (id)"""


def canonical_digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known=LICENSES) -> DataFrame:
    """license_id and digest of each known text; a fixed table of a few rows."""
    rows = spark.createDataFrame([(k, t) for k, t in known], "license_id string, text string")
    return rows.groupBy(canonical_digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known=LICENSES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, canonical_sha256, license_id, notices.

    ``license_id`` names the licence that the whole text is, ``notices`` those that whole lines of it
    are (distinct, sorted, comma-joined; empty without any). A null text counts as empty, which is
    no licence; rows with equal or null ids are kept apart. Other columns are ignored.
    """
    digests = known_digests(docs.sparkSession, known)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(F.translate(x, UPPER, LOWER), F.lit(NOTICE_HINT)))
    # A text without the hint has no such line: it is not cut.
    noticed = F.when(F.contains(F.translate(text, UPPER, LOWER), F.lit(NOTICE_HINT)), F.transform(lines, canonical_digest))
    hashed = docs.select("doc_id", canonical_digest(text).alias("canonical_sha256"), noticed.alias("_lines"))
    whole = hashed.join(F.broadcast(digests), F.col("canonical_sha256") == F.col("digest"), "left").drop("digest")
    # A fixed list of a few rows: one literal map, looked up per line, keeps a row in its task.
    pairs = [F.lit(x) for row in digests.orderBy("digest").collect() for x in (row["digest"], row["license_id"])]
    known_map = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    found = F.array_sort(F.array_distinct(F.filter(F.transform("_lines", lambda d: F.try_element_at(known_map, d)), lambda x: x.isNotNull())))
    return whole.select(
        "doc_id", "canonical_sha256", "license_id", F.coalesce(F.array_join(found, ","), F.lit("")).alias("notices")
    )
