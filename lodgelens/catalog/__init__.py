"""Every operator run over whole test tables, next to the SQL that must agree with it.

The tables stand in for listings and reviews: part and customer for listings, nation and
brand for places, lineitem and documents for reviews, embeddings for chunk vectors,
benchmark items for questions and listing names, events for the request log.
"""

from lodgelens.catalog import (  # noqa: F401
    aggregates,
    ingest,
    joins,
    logs,
    questions,
    retrieval,
    scalars,
    streams,
    windows,
)
from lodgelens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
