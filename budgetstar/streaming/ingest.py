"""Incremental bronze: pick up new CSV files, append them, remember what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from budgetstar.sources.bronze import scan_csv

FILE_LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_incremental(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, multi_line: bool = True
) -> StreamingQuery:
    """Append the files added to ``source`` since the last call and stop.

    The stream carries the names of new files; each delivery is read by header like any other CSV,
    so columns in another order land where they belong, and a file with a column outside
    ``schema`` stops the query with an error that names it, before anything is written. A delivery
    is one folder ``delivery=N`` that a repeated batch replaces, so a rerun after a failure neither
    skips nor repeats a file. The checkpoint folder has to be on shared storage.
    """

    def write(batch: DataFrame, number: int) -> None:
        files = [r.path for r in batch.select("path").where("length > 0").collect()]
        if files:
            rows = scan_csv(batch.sparkSession, files, schema, multi_line)
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/delivery={number}")

    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_LISTING)
        .load(source)
        .select("path", "length")
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
