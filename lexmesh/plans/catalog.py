"""All registered queries of the library, and the SQL that states what each returns."""

from __future__ import annotations

from . import audit_queries, corpus_queries, unseen_queries, vector_queries  # noqa: F401  the modules register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
