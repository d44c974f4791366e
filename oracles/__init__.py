"""DuckDB twins of the registered queries, written against the raw tables."""

from oracles.twins import ORACLES

__all__ = ["ORACLES"]
