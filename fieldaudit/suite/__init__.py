"""Registered queries over the driver's tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from .base import ORACLES, QUERIES
from . import corpus_queries, grid_queries, incremental_queries, profile_queries, protocol_queries, raster_queries, score_queries, sheet_queries, stats_queries  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
