"""Where a question goes: numbers, one listing, one place, small talk or back to the user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.functions.audit import audit_verdict, unfenced_sql
from lodgelens.functions.intents import scope_override
from lodgelens.functions.once import with_once
from lodgelens.operators.matching import match_listings, match_places
from lodgelens.session import materialise


def resolve_scopes(questions: DataFrame, places: DataFrame, listings: DataFrame) -> DataFrame:
    """Route ``(question_id, text, intent, scope)`` rows.

    Order of precedence for review questions: listing in the scope, place in the scope,
    place named in the text, listing named in the text, else ``clarify``. The two matches
    run only over questions that need them.
    """
    scoped = F.col("scope").isNotNull()
    kind = F.col("scope.kind")
    labelled = questions.withColumn("intent", scope_override(F.col("intent"), F.col("text"), scoped))
    # Read three times below; the labels behind it may be costly to work out.
    labelled = materialise(labelled, "labelled-questions")
    explicit = F.coalesce(kind.isin("listing", "neighbourhood"), F.lit(False))
    open_rag = labelled.filter((F.col("intent") == "rag") & ~explicit).select("question_id", "text")
    # Needed twice, and narrow: an id and a name per question.
    place = match_places(open_rag, places, "question_id", "text", "place_name")
    place = materialise(place, "named-places")
    unplaced = open_rag.join(place, "question_id", "left_anti")
    listing = match_listings(unplaced, listings, "question_id", "text", "listing_id", "listing_name")
    named = listing.select("question_id", "listing_id").join(
        listings.select("listing_id", "listing_name"), "listing_id"
    )
    # A question is in one of the two at most, so one join brings both back.
    found = place.select("question_id", F.col("place").alias("text_place")).unionByName(
        named.select(
            "question_id",
            F.col("listing_id").alias("text_listing"),
            F.col("listing_name").alias("text_listing_name"),
        ),
        allowMissingColumns=True,
    )
    joined = labelled.join(found, "question_id", "left")
    rag = F.col("intent") == "rag"
    by_listing = rag & (kind == "listing")
    by_place = rag & (kind == "neighbourhood")
    listing_id = F.when(by_listing, F.col("scope.listing_id")).otherwise(F.col("text_listing"))
    listing_name = F.when(by_listing, F.col("scope.label")).otherwise(F.col("text_listing_name"))
    neighbourhood = F.when(by_place, F.col("scope.neighbourhood")).otherwise(F.col("text_place"))
    route = (
        F.when(~rag, F.col("intent"))
        .when(F.col("listing_id").isNotNull(), "listing")
        .when(F.coalesce(F.col("neighbourhood"), F.lit("")) != "", "place")
        .otherwise("clarify")
    )
    return (
        joined.withColumns(
            {
                "listing_id": listing_id,
                "listing_name": listing_name,
                "neighbourhood": neighbourhood,
            }
        )
        .withColumn("route", route)
        .select(
            "question_id", "text", "intent", "route", "listing_id", "listing_name", "neighbourhood"
        )
    )


def audit_statements(statements: DataFrame, column: str = "statement") -> DataFrame:
    """Add the verdict and the runnable text (null unless the verdict is ``ok``)."""
    audited = statements.withColumn("clean_sql", unfenced_sql(F.col(column)))
    audited = with_once(audited, {"verdict": audit_verdict(F.col("clean_sql"))})
    return audited.withColumn("clean_sql", F.when(F.col("verdict") == "ok", F.col("clean_sql")))
