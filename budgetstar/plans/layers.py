"""Layers kept once per application, so that many queries share one build of the star.

Layers are ordinary Parquet tables in the shared folder named by ``spark.checkpoint.dir``: they
survive lost executors and cut lineage. Only a local session without that setting gets a folder of
its own, which goes when the process ends; on a cluster the setting is required.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetstar.model import DIMENSIONS, FACT, Star
from budgetstar.operators.clean import clean_silver
from budgetstar.operators.star import build_star, keyed_wide
from budgetstar.sources import fixture
from budgetstar.sources.bronze import write_csv
from budgetstar.sources.parquet import read_layer, read_star, write_layer, write_star
from budgetstar.sources.shared import application_folder

_lock = threading.RLock()
_built: dict[tuple[str, str], str] = {}


def _kept(spark: SparkSession, name: str, write: Callable[[str], object]) -> str:
    """Folder of a finished layer; a failed attempt leaves nothing that could be read as one."""
    root = application_folder(spark)
    key = (spark.sparkContext.applicationId, name)
    with _lock:
        if key not in _built:
            folder = f"{root}/{name}-{uuid.uuid4().hex[:8]}"
            write(folder)
            _built[key] = folder
        return _built[key]


class Layers:
    """Wide, silver and gold tables of one source folder. Source files are taken as fixed."""

    def __init__(self, spark: SparkSession, source: str, run: str = "first"):
        self.spark, self.source = spark, source.rstrip("/")
        self._tag = f"{hashlib.md5(self.source.encode()).hexdigest()[:12]}-{run}"

    @property
    def wide(self) -> DataFrame:
        return fixture.wide_budget(self.spark, self.source)

    @property
    def csv_folder(self) -> str:
        """The source as two deliveries of CSV files, the second with its columns in reverse order."""

        def write(to: str) -> None:
            text = fixture.bronze_text(self.spark, self.source)
            key = fixture.bronze_headers(["key_value"])["key_value"]
            first = F.regexp_extract(key, r"-(\d+)", 1).cast("int") % 2 == 0
            write_csv(text.where(first), f"{to}/delivery_1")
            write_csv(text.where(~first).select(*reversed(text.columns)), f"{to}/delivery_2")

        return _kept(self.spark, f"{self._tag}-csv", write)

    @property
    def silver_folder(self) -> str:
        def write(to: str) -> None:
            for wide in fixture.budget_slices(self.spark, self.source):
                write_layer(keyed_wide(clean_silver(wide)), to, mode="append")

        return _kept(self.spark, f"{self._tag}-silver", write)

    @property
    def silver(self) -> DataFrame:
        """Cleaned wide records with imputed sector, surrogate keys and ``has_amount``."""
        return read_layer(self.spark, self.silver_folder)

    @property
    def gold_folder(self) -> str:
        return _kept(
            self.spark, f"{self._tag}-gold", lambda to: write_star(build_star(self.silver, fixture.CUTOFF), to)
        )

    @property
    def star(self) -> Star:
        return read_star(self.spark, self.gold_folder, fixture.CUTOFF)

    def folders(self) -> dict[str, str]:
        """Layer name to table folder, for the storage audit."""
        found = {f"source/{t}": f"{self.source}/{t}.parquet" for t in fixture.TABLES}
        found["silver"] = self.silver_folder
        return found | {f"gold/{t}": f"{self.gold_folder}/{t}" for t in (FACT, *[d.table for d in DIMENSIONS])}
