"""Running trace statistics over a folder of JSON-lines logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from budgetstar.functions.money import as_double
from budgetstar.operators.logs import duration_band, trace_stages


def read_trace_stream(spark: SparkSession, source: str) -> DataFrame:
    return spark.readStream.text(source).withColumnRenamed("value", "payload")


def stage_counts(log: DataFrame) -> DataFrame:
    """Runs, failures and exact total duration per stage; the state is one row per stage."""
    return trace_stages(log).groupBy("stage").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("duration_ms").alias("total_ms"),
    )


def band_counts(log: DataFrame) -> DataFrame:
    """The same per stage and band of durations; the state is some 750 rows per stage at most.

    Runs without a duration are in the band NULL. ``low`` and ``high`` are the outermost durations.
    """
    band = F.when(F.col("duration_ms").isNotNull(), duration_band())
    return trace_stages(log).groupBy("stage", band.alias("band")).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("duration_ms").alias("total_ms"),
        F.min("duration_ms").alias("low"),
        F.max("duration_ms").alias("high"),
    )


def stage_percentiles(bands: DataFrame, percents: Sequence[int] = (50, 95)) -> DataFrame:
    """Per stage counts and, for each percentile, the band it lies in and the durations that bound it.

    ``bands`` is a table of ``band_counts``: what a stream has kept so far. The exact percentile, the
    smallest duration that reaches the rank, lies in that very band, whose ends are 4.4 % apart.
    """
    by_stage = Window.partitionBy("stage")
    so_far = by_stage.orderBy(F.col("band").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    timed = F.when(F.col("band").isNotNull(), F.col("runs")).otherwise(F.lit(0))
    counted = bands.withColumn("timed", F.sum(timed).over(by_stage)).withColumn("upto", F.sum(timed).over(so_far))
    found = []
    for p in percents:
        before = F.col("upto") - F.col("runs")
        holds = F.col("band").isNotNull() & (F.col("upto") * 100 >= F.col("timed") * p) & (before * 100 < F.col("timed") * p)
        for name, column in (("band", F.col("band")), ("low", as_double(F.col("low"))), ("high", as_double(F.col("high")))):
            found.append(F.max(F.when(holds, column)).alias(f"p{p}_{name}"))
    return counted.groupBy("stage").agg(
        F.sum("runs").alias("runs"), F.sum("failed").alias("failed"), as_double(F.max("high")).alias("max_ms"), *found
    )


def write_stage_counts(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest counts in a Parquet table, one row per stage."""
    return _keep(stage_counts(log), target, checkpoint)


def write_band_counts(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest counts per stage and band in a Parquet table."""
    return _keep(band_counts(log), target, checkpoint)


def _keep(counts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Every batch holds the counts since the beginning and replaces the table.

    They are few, so they are written by one task, and a repeated batch writes the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(target)

    return (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
