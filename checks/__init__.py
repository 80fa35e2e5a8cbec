"""Registered queries: library operators over the given tables, with SQL to compare against."""

from checks.base import ORACLE, QUERIES
from checks import learning, lines, rules, scans, stores, streams, text  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
