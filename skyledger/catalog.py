"""Imports every module that registers queries, so that the registry is full."""

from __future__ import annotations

from skyledger.plans import forecast_queries, market_queries, structure_queries
from skyledger.registry import ORACLE_SQL, QUERIES
from skyledger.sources import queries as source_queries
from skyledger.streaming import queries as streaming_queries

market_queries.register_scalars()

__all__ = ["ORACLE_SQL", "QUERIES", "forecast_queries", "source_queries", "streaming_queries", "structure_queries"]
