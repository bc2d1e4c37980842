"""Imports every query module, which fills the catalogue."""

from __future__ import annotations

from . import (  # noqa: F401
    detector_queries,
    evaluation_queries,
    event_queries,
    findings_queries,
    scoring_queries,
    source_queries,
    streaming_queries,
)
from .catalog import QUERIES, oracle_sql

ORACLES = oracle_sql()

__all__ = ["ORACLES", "QUERIES"]
