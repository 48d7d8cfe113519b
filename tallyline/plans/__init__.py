"""The registered queries over the given tables, each with its SQL twin where there is one."""

from . import draft_queries, event_queries, export_queries, model_queries, season_queries  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
