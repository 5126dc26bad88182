"""Registered queries: each pairs a DataFrame plan with the SQL that must give the same rows."""

from tideline.catalog import basics, cohort, matrix, stats, text  # noqa: F401  (fills the registry)
from tideline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
