"""Public-budget analytics on Spark: ingest, clean, unpivot, star schema, gate, reports."""

from budgetstar.model import DIMENSIONS, ENTITY_KEYS, FACT_COLUMNS, PHASES, Star

__all__ = ["DIMENSIONS", "ENTITY_KEYS", "FACT_COLUMNS", "PHASES", "Star"]
