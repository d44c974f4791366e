"""Executive reports: fixed questions over the star. Text columns are built from decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetstar.functions.money import as_double, billions, percent_text
from budgetstar.functions.text import is_blank
from budgetstar.model import BY_NAME, EXECUTED, PLANNED, Star
from budgetstar.operators.aggregate import Measure, aggregate, guard_year, top


def _executed_in(year: int) -> list[Column]:
    return [F.col("anio") == year, F.col("fase") == EXECUTED]


def _labelled(column: str) -> list[Column]:
    return [~is_blank(F.col(column))]


def top_departments(star: Star, year: int, limit: int = 5) -> DataFrame:
    """Departments by executed amount and their share of all labelled departments."""
    label = "departamento_ejecutora_nombre"
    groups = aggregate(
        star,
        {"total": Measure()},
        {"department": label},
        fact_where=_executed_in(year),
        where=_labelled(label),
        how="inner",
    )
    national = groups.agg(F.sum("total")).scalar()
    shares = top(groups.withColumn("national", national), "total", limit, "department")
    return shares.select(
        "department",
        as_double(billions(F.col("total"))).alias("billion_soles"),
        percent_text(F.col("total"), F.col("national")).alias("percentage_of_national_total"),
    )


def pim_growth(star: Star, guard: bool = True) -> DataFrame:
    """Planned budget per year against the year before.

    The window has one partition, over one row per fiscal year: its size is the number of years.
    """
    yearly = aggregate(star, {"pim": Measure()}, {"fiscal_year": "anio"}, fact_where=[F.col("fase") == PLANNED], guard=guard)
    before = F.lag("pim").over(Window.orderBy("fiscal_year"))
    steps = yearly.withColumn("before", before).withColumn("delta", F.col("pim") - F.col("before"))
    growth = percent_text(F.col("delta"), F.col("before"))
    return steps.select(
        "fiscal_year",
        as_double(billions(F.col("pim"))).alias("total_pim_billions"),
        as_double(F.coalesce(billions(F.col("delta")), F.lit(0))).alias("net_variance_billions"),
        F.coalesce(growth, F.lit("0.0 %")).alias("yoy_growth_percentage"),
    ).orderBy("fiscal_year")


def _sector_rows(star: Star, year: int) -> DataFrame:
    """Executed amount per sector and project, from one sum per pair of keys.

    Both steps combine inside tasks before they move anything, so a sector that holds most of the
    data costs no more than its distinct projects.
    """
    institution, program = BY_NAME["institucion"], BY_NAME["programatica"]
    fact = guard_year(star.fact, star.cutoff)
    for condition in _executed_in(year):
        fact = fact.where(condition)
    pairs = fact.groupBy(institution.key, program.key).agg(F.sum("monto").alias("total"))
    sectors = star.dim("institucion").select(institution.key, "sector_nombre").where(_labelled("sector_nombre")[0])
    projects = star.dim("programatica").select(program.key, "producto_proyecto")
    return pairs.join(sectors, institution.key).join(projects, program.key)


def sector_projects(star: Star, year: int, limit: int = 5) -> DataFrame:
    """Sectors by executed amount with the exact number of distinct projects."""
    per_project = _sector_rows(star, year).groupBy("sector_nombre", "producto_proyecto").agg(F.sum("total").alias("total"))
    groups = per_project.groupBy("sector_nombre").agg(
        F.count("producto_proyecto").alias("projects"), F.sum("total").alias("total")
    )
    return _sector_report(groups, limit)


def sector_projects_approx(star: Star, year: int, limit: int = 5, rsd: float = 0.05) -> DataFrame:
    """The same with a sketch per sector: one aggregation less, count within the given deviation."""
    groups = _sector_rows(star, year).groupBy("sector_nombre").agg(
        F.approx_count_distinct("producto_proyecto", rsd).alias("projects"), F.sum("total").alias("total")
    )
    return _sector_report(groups, limit)


def _sector_report(groups: DataFrame, limit: int) -> DataFrame:
    return top(groups, "total", limit, "sector_nombre").select(
        F.col("sector_nombre").alias("government_sector"),
        F.format_number("projects", 0).alias("estimated_project_count"),
        as_double(billions(F.col("total"))).alias("expenditure_billions"),
    )


def centralization(star: Star, year: int, department: str = "LIMA", limit: int = 5) -> DataFrame:
    """Sectors by executed amount and the part executed in one department."""
    label = "sector_nombre"
    cells = aggregate(
        star,
        {"total": Measure()},
        {"sector": label, "department": "departamento_ejecutora_nombre"},
        fact_where=_executed_in(year),
        where=_labelled(label),
        how="inner",
    )
    central = F.when(F.upper("department") == department.strip().upper(), F.col("total")).otherwise(F.lit(0))
    groups = cells.groupBy("sector").agg(F.sum("total").alias("total"), F.sum(central).alias("central"))
    return top(groups, "total", limit, "sector").select(
        F.col("sector").alias("government_sector"),
        as_double(billions(F.col("total"))).alias("total_devengado_billions"),
        as_double(billions(F.col("central"))).alias("lima_devengado_billions"),
        percent_text(F.col("central"), F.col("total")).alias("lima_centralization_rate"),
    )
