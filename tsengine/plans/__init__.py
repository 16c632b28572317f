"""Registered queries over the given tables."""

from . import cleaning, filters, loop, results, shaping  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
