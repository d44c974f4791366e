"""Worked question patterns over the star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetstar.functions.money import as_double, rate_pct_or_null
from budgetstar.model import EXECUTED, PLANNED, Star
from budgetstar.operators.aggregate import (
    PLANNED_AND_EXECUTED,
    Filters,
    aggregate,
    doubles,
    phase_total,
    top,
)
from budgetstar.operators.grain import rank_then_follow

TOTAL_PIM = {"total_pim": phase_total(PLANNED)}


def contains(column: str, term: str) -> Column:
    """Case-insensitive contains; the term is text, not a pattern."""
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"%{escaped}%")


def total_pim(star: Star, year: int) -> DataFrame:
    return doubles(aggregate(star, TOTAL_PIM, filters=Filters(year=year)), "total_pim")


def sector_rate(star: Star, year: int) -> DataFrame:
    groups = aggregate(star, PLANNED_AND_EXECUTED, {"sector": "sector_nombre"}, Filters(year=year))
    rated = groups.select("sector", rate_pct_or_null(F.col("devengado"), F.col("pim")).alias("execution_rate"))
    return top(rated, "execution_rate", None, "sector")


def top5_departments(star: Star, year: int) -> DataFrame:
    by = {"department": "departamento_ejecutora_nombre"}
    groups = aggregate(star, TOTAL_PIM, by, Filters(year=year))
    return doubles(top(groups, "total_pim", 5, "department"), "total_pim")


def level_compare(star: Star, year: int) -> DataFrame:
    by = {"government_level": "nivel_gobierno_nombre"}
    groups = aggregate(star, PLANNED_AND_EXECUTED, by, Filters(year=year))
    return doubles(top(groups, "pim", None, "government_level"), "pim", "devengado")


def by_source(star: Star, year: int) -> DataFrame:
    by = {"financing_source": "fuente_financiamiento_nombre"}
    groups = aggregate(star, TOTAL_PIM, by, Filters(year=year))
    return doubles(top(groups, "total_pim", None, "financing_source"), "total_pim")


def top_project_trend(star: Star, level_term: str, department_term: str, limit: int = 1) -> DataFrame:
    """The project with the largest executed amount under two contains-filters, year by year."""
    key, label = "sk_programatica_id", "producto_proyecto_nombre"
    ranked = aggregate(
        star,
        {"total": phase_total(EXECUTED)},
        {key: key, label: label},
        where=[contains("nivel_gobierno_nombre", level_term), contains("departamento_ejecutora_nombre", department_term)],
        where_columns=["nivel_gobierno_nombre", "departamento_ejecutora_nombre"],
    )
    winners = top(ranked, "total", limit, label, key)
    measures = {"gasto_anual": phase_total(EXECUTED), "pim_anual": phase_total(PLANNED)}
    trend = rank_then_follow(star, winners, key, label, measures)
    named = trend.withColumnRenamed(label, "proyecto").orderBy("proyecto", "anio")
    return doubles(named, "gasto_anual", "pim_anual")


def multi_family_union(star: Star, limit: int = 10) -> DataFrame:
    """Top groups of two families, each at its own grain, tagged and stacked."""

    def ranked(tag: str, column: str) -> DataFrame:
        groups = aggregate(star, {"pim": phase_total(PLANNED)}, {"name": column})
        return top(groups, "pim", limit, "name").select(F.lit(tag).alias("dimension"), "name", "pim")

    both = ranked("sector", "sector_nombre").unionByName(
        ranked("financing_source", "fuente_financiamiento_nombre")
    )
    return doubles(both.orderBy("dimension", F.col("pim").desc(), "name"), "pim")


def ilike_filter(star: Star, column: str, term: str) -> DataFrame:
    """Planned and executed totals of the members whose label contains the term."""
    groups = aggregate(star, PLANNED_AND_EXECUTED, {"label": column}, where=[contains(column, term)])
    return groups.select("label", as_double(F.col("pim")).alias("pim"), as_double(F.col("devengado")).alias("devengado"))
