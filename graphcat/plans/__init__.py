"""Queries over the derived tables, with their DuckDB twins."""

from . import build_queries, check_queries, context_queries, fold_queries, graph_queries, keyed_queries, rule_queries, scope_queries, store_queries, time_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
