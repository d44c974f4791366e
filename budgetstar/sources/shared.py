"""The folder all executors can reach, and intermediate tables kept in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tempfile.TemporaryDirectory] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a folder that goes with the process. On a cluster the
    setting is required: a folder of one machine would be of no use to the others, and working
    without one would repeat every intermediate result.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors can reach")
        if not _scratch:
            _scratch.append(tempfile.TemporaryDirectory(prefix="budgetstar-"))
        root = _scratch[0].name
    return root


def application_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/budgetstar/{spark.sparkContext.applicationId}"


# Held while a layer is written. Shuffle files of a write go with its end, not when the driver happens
# to collect its garbage: the next layer finds their disk free. Methods that the JIT compiler would
# refuse are split (as in ``session.SETTINGS``, for sessions that were built without them).
WRITE_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


@contextmanager
def write_settings(spark: SparkSession, more: Mapping[str, str] | None = None) -> Iterator[None]:
    settings = {**WRITE_SETTINGS, **(more or {})}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut_lineage(table: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back.

    Several passes then read one result, only the columns and rows they need, and a lost executor
    costs nothing. ``drop_intermediate`` removes what an application has left there.
    """
    path = f"{application_folder(table.sparkSession)}/kept-{uuid.uuid4().hex[:12]}"
    table.write.option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def drop_intermediate(spark: SparkSession) -> None:
    """Delete all layers and kept tables of this application; results read from them end with it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
