"""Registered queries of the library and their DuckDB oracles."""

from __future__ import annotations

from quarry.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
