"""The batch job: CSV exports to bronze, silver and gold tables and the listing view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodgelens import schemas
from lodgelens.functions.values import PRICE_MAX, PRICE_MIN
from lodgelens.operators import cleaning, sampling
from lodgelens.operators.chunks import build_chunks
from lodgelens.operators.views import enriched_listings, register_view
from lodgelens.sources.csv_files import read_export
from lodgelens.sources.tables import overwrite_table, require_columns


@dataclass(frozen=True)
class Exports:
    """Locations of the exports of one city."""

    listings: str
    reviews: str
    neighbourhoods: str
    city: str = "rome"
    multiline: bool = True


@dataclass(frozen=True)
class Settings:
    reviews_per_listing: int = sampling.REVIEWS_PER_LISTING
    listings_per_place: int = sampling.LISTINGS_PER_PLACE
    price_min: float = PRICE_MIN
    price_max: float = PRICE_MAX
    languages: tuple[str, ...] = cleaning.KEPT_LANGUAGES


class TableSet:
    """Names the tables of one run, all in one database and optionally under one folder."""

    def __init__(self, database: str = "default", prefix: str = "", folder: str | None = None):
        self.database, self.prefix, self.folder = database, prefix, folder

    def name(self, table: str) -> str:
        return f"{self.database}.{self.prefix}{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Partitioned by city, as every later join and question names one."""
        path = f"{self.folder}/{table}" if self.folder else None
        return overwrite_table(df, self.name(table), ["city"], path)


def run_batch(
    spark: SparkSession,
    exports: Exports,
    tables: TableSet | None = None,
    settings: Settings | None = None,
) -> dict[str, DataFrame]:
    """Write all layers and return the stored tables by name.

    Each layer is written once and read back by the next, so no step runs twice and a
    lost executor costs at most the layer in progress.
    """
    tables, settings = tables or TableSet(), settings or Settings()
    city, multiline = exports.city, exports.multiline
    out: dict[str, DataFrame] = {}

    def store(df: DataFrame, table: str) -> DataFrame:
        out[table] = tables.write(df, table)
        return out[table]

    listings = store(
        read_export(spark, exports.listings, schemas.LISTINGS, city, multiline), "bronze_listings"
    )
    places = store(
        read_export(spark, exports.neighbourhoods, schemas.NEIGHBOURHOODS, city, multiline),
        "bronze_neighbourhoods",
    )
    # Not spread after the scan: the sample cuts the rows down before their one shuffle.
    raw_reviews = read_export(spark, exports.reviews, schemas.REVIEWS, city, multiline)
    reviews = store(
        sampling.stratified_reviews(
            listings, raw_reviews, settings.listings_per_place, settings.reviews_per_listing
        ),
        "bronze_reviews",
    )
    clean_listings = store(
        cleaning.silver_listings(listings, settings.price_min, settings.price_max),
        "silver_listings",
    )
    clean_places = store(cleaning.silver_neighbourhoods(places), "silver_neighbourhoods")
    clean_reviews = store(cleaning.silver_reviews(reviews, settings.languages), "silver_reviews")
    require_columns(clean_reviews, "comments")
    store(build_chunks(clean_reviews, clean_listings), "gold_review_chunks")
    out["listings_enriched"] = register_view(enriched_listings(clean_listings, clean_places))
    return out
