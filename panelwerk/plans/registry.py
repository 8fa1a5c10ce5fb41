"""Queries of the corpus operators and their SQL twins, by name."""

from __future__ import annotations

from . import layout_queries, report_queries, review_queries, state_queries, text_queries  # noqa: F401
from .book import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
