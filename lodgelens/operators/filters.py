"""Per-query filters as routes: a query sees only items offered under its own route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.bounds import broadcast_if_small
from lodgelens.functions.text import normalise_name

#: Columns a query may filter by; null or blank means no filter.
FILTERS = ["listing_id", "neighbourhood"]


def filter_route(listing: Column, place: Column) -> Column:
    """Text that names a filter combination; a part that is not filtered stays empty."""
    named = F.coalesce(F.concat(F.lit("="), place), F.lit(""))
    return F.concat(F.coalesce(listing.cast("string"), F.lit("")), F.lit("|"), named)


def asked_route() -> Column:
    """Route of a query by its filter columns; place names are folded like the index's."""
    place = F.nullif(normalise_name(F.col("neighbourhood")), F.lit(""))
    return filter_route(F.col("listing_id"), place)


def offered_routes() -> Column:
    """Every filter combination an item satisfies, as an array."""
    nothing = F.lit(None).cast("string")
    listing, place = F.col("listing_id"), F.col("neighbourhood")
    routes = [filter_route(a, b) for a in (nothing, listing) for b in (nothing, place)]
    return F.array_distinct(F.array(*routes))


def wanted_items(items: DataFrame, queries: DataFrame, column: str = "route") -> DataFrame:
    """Items on a route some query asks for; the others are dropped where they are read."""
    return items.join(broadcast_if_small(queries.select(column).distinct()), column, "left_semi")
