"""Parquet layers: write once, read with pushdown, register as views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from budgetstar.model import DIMENSIONS, FACT, FACT_COLUMNS, FACT_SCHEMA, YEAR_CUTOFF, Star, cell_columns
from budgetstar.sources.shared import write_settings

OPEN_FILES = 16  # of one task, when a layer is split by values
ROW_GROUP = 32 << 20  # bytes, in such files
PAGE_ROWS = 200_000  # longer pages compress better


def write_layer(
    table: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> DataFrame:
    """With ``partition_by`` a task keeps a file open per value and writes rows in the order they come.

    Sorting them by value first would put all rows of a task on local disk once more. Up to OPEN_FILES
    files are open at once, rows of further values are sorted; smaller row groups bound their memory.
    Amounts hardly repeat, so those of wide records are stored without trying a dictionary first.
    """
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in cell_columns(table.columns)}
    writer = table.write.mode(mode).options(**{"compression": "zstd", "parquet.page.row.count.limit": PAGE_ROWS, **plain})
    settings = {}
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("parquet.block.size", ROW_GROUP)
        settings = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}
    with write_settings(table.sparkSession, settings):
        writer.parquet(path)
    return read_layer(table.sparkSession, path)


def read_layer(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """With a schema no footer is read before the query runs."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"Parquet layer not found: {path}") from error
        raise


def write_star(star: Star, folder: str, mode: str = "errorifexists") -> Star:
    """Gold tables; the fact is split by year, so a year filter skips folders.

    Fact rows, the largest table of all, are written where they are unpivoted: none is moved or
    sorted. A task holds the records of one split of silver, so the number of files follows the bytes
    of silver times the number of years. The phases of a record stay together, and with them keys and
    equal amounts, which takes less disk than an order by phase.
    """
    spark = star.fact.sparkSession
    for dimension in DIMENSIONS:
        write_layer(star.dim(dimension.name), f"{folder}/{dimension.table}", mode=mode)
    write_layer(star.fact, f"{folder}/{FACT}", partition_by=["anio"], mode=mode)
    return read_star(spark, folder, star.cutoff)


def read_star(spark: SparkSession, folder: str, cutoff: int = YEAR_CUTOFF) -> Star:
    """All six gold tables; a missing one raises FileNotFoundError before any query runs."""
    fact = read_layer(spark, f"{folder}/{FACT}", FACT_SCHEMA).select(*FACT_COLUMNS)
    dims = {d.name: read_layer(spark, f"{folder}/{d.table}", d.schema) for d in DIMENSIONS}
    return Star(fact=fact, dims=dims, cutoff=cutoff)


def register_star(star: Star) -> list[str]:
    """Gold tables as session views under their usual names, ready for ``spark.sql``."""
    for name, table in star.tables().items():
        table.createOrReplaceTempView(name)
    return list(star.tables())


def open_star(spark: SparkSession, folder: str, cutoff: int = YEAR_CUTOFF) -> Star:
    star = read_star(spark, folder, cutoff)
    register_star(star)
    return star
