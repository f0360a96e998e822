"""All queries of the library, gathered from the modules that register them."""

from __future__ import annotations

from . import evaluation_queries, fingerprint_queries, function_queries, graph_queries, source_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
