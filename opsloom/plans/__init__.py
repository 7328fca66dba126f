"""The catalogue of queries: operators bound to tables, each with its SQL."""

from __future__ import annotations

from . import app_views, format_views, incident_views, ingest_views, predicate_views, search_views, state_views, storm_views, stored_views, views  # noqa: F401 (they register their queries)
from .catalog import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
