"""Filterable dashboard queries: KPIs and breakdowns over the star."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetstar.functions.money import as_double, rate_pct, unexecuted_gap
from budgetstar.functions.text import label_or_unspecified
from budgetstar.model import ENTITY_KEYS, EXECUTED, PLANNED, Star
from budgetstar.operators.aggregate import (
    PLANNED_AND_EXECUTED,
    Filters,
    aggregate,
    doubles,
    guard_year,
    phase_total,
    top,
)
from budgetstar.operators.reshape import pivot_years

# Columns each breakdown accepts.
CONCENTRATION_COLUMNS = ("sector_nombre", "departamento_ejecutora_nombre")
VARIANCE_COLUMNS = ("sector_nombre", "departamento_ejecutora_nombre", "nivel_gobierno_nombre")
PROGRAM_COLUMNS = ("programa_ppto_nombre", "producto_proyecto_nombre", "funcion_nombre")


def _accept(column: str, allowed: Collection[str]) -> str:
    if column not in allowed:
        raise ValueError(f"Invalid grouping column '{column}'. Must be one of: {', '.join(allowed)}")
    return column


def filter_options(star: Star) -> DataFrame:
    """Values of the four filter lists as ``(filter, position, value)``; years newest first."""

    def options(name: str, values: DataFrame, column: str) -> DataFrame:
        return values.where(F.col(column).isNotNull()).select(
            F.lit(name).alias("filter"), F.col(column).cast("string").alias("value")
        )

    institution, geography = star.dim("institucion"), star.dim("geografia")
    lists = [
        options("years", guard_year(star.fact, star.cutoff).select("anio").distinct(), "anio"),
        options("government_levels", institution.select("nivel_gobierno_nombre").distinct(), "nivel_gobierno_nombre"),
        options("sectors", institution.select("sector_nombre").distinct(), "sector_nombre"),
        options(
            "departments", geography.select("departamento_ejecutora_nombre").distinct(), "departamento_ejecutora_nombre"
        ),
    ]
    newest_first = F.when(F.col("filter") == "years", F.col("value"))
    return reduce(DataFrame.unionByName, lists).orderBy("filter", newest_first.desc(), "value")


def phase_totals(star: Star, filters: Filters | None = None) -> DataFrame:
    """Planned and executed totals, one row, 0 when nothing matches."""
    totals = aggregate(star, PLANNED_AND_EXECUTED, filters=filters)
    return totals.select(*[as_double(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in PLANNED_AND_EXECUTED])


def kpis(star: Star, filters: Filters | None = None) -> DataFrame:
    totals = aggregate(star, PLANNED_AND_EXECUTED, filters=filters).select(
        *[F.coalesce(F.col(c), F.lit(0).cast("decimal(38,2)")).alias(c) for c in PLANNED_AND_EXECUTED]
    )
    planned, executed = F.col(PLANNED), F.col(EXECUTED)
    return totals.select(
        as_double(planned).alias("pim"),
        as_double(executed).alias("devengado"),
        rate_pct(executed, planned).alias("execution_rate"),
        as_double(unexecuted_gap(planned, executed)).alias("unexecuted_gap"),
    )


def pair_coverage(star: Star, guard: bool = False) -> DataFrame:
    """Share of entity-years holding both a planned and an executed amount (all years by default).

    The only query that has to move rows by all five keys: seven phases shrink to one row per
    entity-year inside each task first.
    """
    fact = guard_year(star.fact, star.cutoff) if guard else star.fact

    def flag(phase: str):
        return F.max(F.when(F.col("fase") == phase, 1).otherwise(0))

    entity_years = fact.groupBy(*ENTITY_KEYS, "anio").agg(flag(PLANNED).alias("p"), flag(EXECUTED).alias("e"))
    counts = entity_years.agg(
        F.count("*").alias("total_entity_years"),
        F.count_if((F.col("p") == 1) & (F.col("e") == 1)).alias("complete_entity_years"),
    )
    complete, total = F.col("complete_entity_years"), F.col("total_entity_years")
    return counts.withColumn("coverage_pct", rate_pct(complete, total))


def top_concentrations(star: Star, by: str, limit: int = 10, filters: Filters | None = None) -> DataFrame:
    column = _accept(by, CONCENTRATION_COLUMNS)
    return _top_planned(star, column, limit, filters)


def programmatic_allocation(star: Star, by: str, limit: int = 10, filters: Filters | None = None) -> DataFrame:
    column = _accept(by, PROGRAM_COLUMNS)
    return _top_planned(star, column, limit, filters)


def _top_planned(star: Star, column: str, limit: int, filters: Filters | None) -> DataFrame:
    groups = aggregate(star, {"total_monto": phase_total(PLANNED)}, {"dimension": column}, filters)
    return doubles(top(groups, "total_monto", limit, "dimension"), "total_monto")


def _planned_and_executed(star: Star, output: str, column: str, filters: Filters | None) -> DataFrame:
    groups = aggregate(star, PLANNED_AND_EXECUTED, {output: column}, filters)
    return doubles(top(groups, "pim", None, output), "pim", "devengado")


def execution_variance(star: Star, by: str, filters: Filters | None = None) -> DataFrame:
    return _planned_and_executed(star, "dimension", _accept(by, VARIANCE_COLUMNS), filters)


def chart_top(table: DataFrame, label: str, limit: int = 10, measure: str = "pim") -> DataFrame:
    """The largest groups with a readable label for the missing one."""
    named = table.withColumn(label, label_or_unspecified(F.col(label)))
    return top(named, measure, limit, label)


def economic_composition(star: Star, filters: Filters | None = None) -> DataFrame:
    return _planned_and_executed(star, "economic_category", "generica_nombre", filters)


def financing_structure(star: Star, filters: Filters | None = None) -> DataFrame:
    return _planned_and_executed(star, "financing_source", "fuente_financiamiento_nombre", filters)


def geographic_heatmap(star: Star, filters: Filters | None = None) -> DataFrame:
    by = {"department": "departamento_ejecutora_nombre", "fiscal_year": "anio"}
    groups = aggregate(star, PLANNED_AND_EXECUTED, by, filters)
    rated = groups.withColumn("execution_rate", rate_pct(F.col("devengado"), F.col("pim")))
    ordered = rated.orderBy(F.col("department").asc_nulls_last(), F.col("fiscal_year").desc())
    return doubles(ordered, "pim", "devengado")


def heatmap_matrix(
    star: Star, years: Sequence[int], value: str = "execution_rate", filters: Filters | None = None
) -> DataFrame:
    """Department by year matrix of rates, or of planned amounts with ``value="pim"``."""
    cells = geographic_heatmap(star, filters).withColumn("department", label_or_unspecified(F.col("department")))
    return pivot_years(cells, "department", "fiscal_year", value, years)
