"""Registered queries: every operator bound to the given tables, with its SQL counterpart."""

from folioscope.catalog.base import QUERIES, SQL
from folioscope.catalog import documented, etl, models, retrieval, risk, stats, streams  # noqa: F401

__all__ = ["QUERIES", "SQL"]
