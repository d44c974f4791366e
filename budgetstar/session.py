"""Session settings this package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Wide records make generated methods too long for the JIT compiler; past this size Spark
    # splits them instead. Halves the time of the silver layer.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "budgetstar", overrides: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings above; master and memory come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **(overrides or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
