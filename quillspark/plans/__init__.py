"""Registered queries: operators applied to the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import analytics, corpus, paths, records, runs, selection, texts  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
