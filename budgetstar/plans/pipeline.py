"""The batch pipeline: CSV to bronze to silver to gold, the gate, then the reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from budgetstar.model import YEAR_CUTOFF, Star
from budgetstar.operators.clean import clean_silver
from budgetstar.operators.quality import require_reconciled, volumetrics
from budgetstar.operators.star import build_star, keyed_wide
from budgetstar.plans import reports
from budgetstar.sources.bronze import ingest_csv
from budgetstar.sources.parquet import register_star, write_layer, write_star


@dataclass(frozen=True)
class PipelineResult:
    silver: DataFrame
    star: Star
    volumes: DataFrame


def run_pipeline(spark: SparkSession, csv_path: str, target: str, cutoff: int = YEAR_CUTOFF) -> PipelineResult:
    """Build all layers under ``target`` and check them; a money mismatch raises before any report.

    The wide silver table is written once, already keyed; the fact and the five dimensions are
    narrow reads of it. The long table of all phases is not stored: the fact is its projection.
    """
    bronze = ingest_csv(spark, csv_path, f"{target}/bronze")
    silver = write_layer(keyed_wide(clean_silver(bronze)), f"{target}/silver")
    star = write_star(build_star(silver, cutoff), f"{target}/gold")
    require_reconciled(silver, star.fact)
    register_star(star)
    return PipelineResult(silver=silver, star=star, volumes=volumetrics(silver, star.fact))


def executive_reports(star: Star, year: int, department: str = "LIMA") -> dict[str, DataFrame]:
    return {
        "top_departments": reports.top_departments(star, year),
        "pim_growth": reports.pim_growth(star),
        "sector_projects": reports.sector_projects_approx(star, year),
        "centralization": reports.centralization(star, year, department),
    }
