import random
import statistics
from decimal import Decimal
from fractions import Fraction

import pytest
from conftest import tiny_star
from pyspark.sql import functions as F

from budgetstar.operators.aggregate import (
    Filters,
    Measure,
    aggregate,
    guard_year,
    owners,
    phase_total,
)
from budgetstar.operators.grain import (
    AmbiguousColumnError,
    GrainError,
    MixedGrainError,
    UngroupedColumnError,
    UnknownColumnError,
    UnknownTableError,
    check_request,
    grain_aggregate,
    grain_of,
)
from budgetstar.plans import dashboard, questions, reports

ROWS = [
    (1, 2023, "pim", 100),
    (1, 2023, "devengado", 60),
    (2, 2024, "pim", 40),
    (2, 2024, "devengado", 40),
    (3, 2024, "girado", 7),
    (9, 2024, "pim", 5),
    (1, 2026, "pim", 1000),
]
PLACES = [(1, "LIMA"), (2, "CUSCO"), (3, "PUNO")]


@pytest.fixture()
def star(spark):
    return tiny_star(spark, ROWS, PLACES)


def values(table, *columns):
    return [tuple(r[c] for c in columns) for r in table.collect()]


def test_guard_drops_later_years(star):
    assert guard_year(star.fact, 2025).count() == 6


@pytest.mark.parametrize(
    "filters, pim",
    [
        (Filters(), 145.0),
        (Filters("ALL", " all ", None, "ALL"), 145.0),
        (Filters(2024), 45.0),
        (Filters(" 2024 "), 45.0),
        (Filters("02024"), 0.0),
        (Filters("next year"), 0.0),
        (Filters(2026), 0.0),
        (Filters(department=" lima "), 100.0),
        (Filters(department="nowhere"), 0.0),
        (Filters(2023, department="CUSCO"), 0.0),
        (Filters(sector="x", government_level="X"), 145.0),
    ],
)
def test_filters(star, filters, pim):
    assert dashboard.kpis(star, filters).first().pim == pim


def test_kpis_of_nothing_are_zero(star):
    assert tuple(dashboard.kpis(star, Filters(2026)).first()) == (0.0, 0.0, 0.0, 0.0)


def test_gap_never_goes_below_zero(spark):
    star = tiny_star(spark, [(1, 2024, "pim", 1), (1, 2024, "devengado", 3)], PLACES)
    row = dashboard.kpis(star).first()
    assert (row.unexecuted_gap, row.execution_rate) == (0.0, 300.0)


def test_unmatched_facts_form_a_null_group(star):
    rows = values(dashboard.execution_variance(star, "departamento_ejecutora_nombre"), "dimension", "pim", "devengado")
    assert rows == [("LIMA", 100.0, 60.0), ("CUSCO", 40.0, 40.0), (None, 5.0, 0.0), ("PUNO", 0.0, 0.0)]
    labelled = dashboard.chart_top(dashboard.execution_variance(star, "departamento_ejecutora_nombre"), "dimension", 3)
    assert [r.dimension for r in labelled.collect()] == ["LIMA", "CUSCO", "Unspecified"]


def test_equal_measures_are_ordered_by_label(spark):
    star = tiny_star(spark, [(1, 2024, "pim", 5), (2, 2024, "pim", 5)], PLACES)
    rows = values(dashboard.top_concentrations(star, "departamento_ejecutora_nombre", 1), "dimension")
    assert rows == [("CUSCO",)]


@pytest.mark.parametrize(
    "build", [dashboard.top_concentrations, dashboard.execution_variance, dashboard.programmatic_allocation]
)
def test_other_columns_are_refused(star, build):
    with pytest.raises(ValueError, match="Invalid grouping column"):
        build(star, "rubro; DROP TABLE x")


def test_unknown_grouping_column(star):
    with pytest.raises(ValueError, match="Unknown grouping column"):
        aggregate(star, {"pim": phase_total("pim")}, {"x": "no_such_column"})


def test_coverage_counts_complete_entity_years(star):
    row = dashboard.pair_coverage(star).first()
    assert (row.total_entity_years, row.complete_entity_years) == (5, 2)
    assert dashboard.pair_coverage(star, guard=True).first().total_entity_years == 4


def test_filter_lists(star):
    rows = values(dashboard.filter_options(star), "filter", "value")
    assert [v for f, v in rows if f == "years"] == ["2024", "2023"]
    assert [v for f, v in rows if f == "departments"] == ["CUSCO", "LIMA", "PUNO"]


def test_heatmap_order(star):
    rows = values(dashboard.geographic_heatmap(star), "department", "fiscal_year", "execution_rate")
    assert rows == [("CUSCO", 2024, 100.0), ("LIMA", 2023, 60.0), ("PUNO", 2024, 0.0), (None, 2024, 0.0)]
    matrix = values(dashboard.heatmap_matrix(star, [2023, 2024], "pim"), "department", "y2023", "y2024")
    assert matrix == [("Unspecified", 0.0, 5.0), ("PUNO", 0.0, 0.0), ("LIMA", 100.0, 0.0), ("CUSCO", 0.0, 40.0)]


def test_growth_report_starts_at_zero(star):
    rows = values(reports.pim_growth(star), "fiscal_year", "yoy_growth_percentage")
    assert rows == [(2023, "0.0 %"), (2024, "-55.0 %")]
    assert len(reports.pim_growth(star, guard=False).collect()) == 3


def test_department_shares_leave_out_unlabelled(spark):
    rows = [(1, 2024, "devengado", 2_000_000_000), (2, 2024, "devengado", 1_000_000_000), (9, 2024, "devengado", 5)]
    star = tiny_star(spark, rows, [*PLACES, (4, " ")])
    got = values(reports.top_departments(star, 2024), "department", "billion_soles", "percentage_of_national_total")
    assert got == [("LIMA", 2.0, "66.67 %"), ("CUSCO", 1.0, "33.33 %")]


def test_contains_filter_takes_text_not_patterns(spark):
    rows = spark.createDataFrame([("100% Lima",), ("LIMA",)], "label string")
    assert [r.label for r in rows.where(questions.contains("label", "0% l")).collect()] == ["100% Lima"]
    assert rows.where(questions.contains("label", "_")).count() == 0


def test_only_owning_dimensions_are_joined(star):
    assert owners([]) == []
    assert [d.name for d in owners(["rubro", *Filters(sector="X").labels()])] == ["institucion", "financiamiento"]
    plan = dashboard.economic_composition(star)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert dashboard.kpis(star)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_moments_match_plain_statistics(spark):
    amounts = [10.25, 20.5, 7.75, 99.99, 0.01]
    star = tiny_star(spark, [(1, 2024, "pim", a) for a in amounts], PLACES)
    names = ("sum", "count", "avg", "min", "max", "stddev", "variance")
    row = aggregate(star, {n: Measure(n) for n in names}, {"d": "departamento_ejecutora_nombre"}).first()
    assert float(row["sum"]) == pytest.approx(sum(amounts)) and row["count"] == 5
    assert row["avg"] == pytest.approx(statistics.mean(amounts))
    assert row["variance"] == pytest.approx(statistics.variance(amounts))
    assert row["stddev"] == pytest.approx(statistics.stdev(amounts))
    single = tiny_star(spark, [(1, 2024, "pim", 3)], PLACES)
    assert aggregate(single, {"v": Measure("variance")}, {"y": "anio"}).first().v is None


@pytest.mark.parametrize("by", [{}, {"y": "anio"}, {"d": "departamento_ejecutora_nombre"}])
def test_variance_of_near_equal_billions(spark, by):
    amounts = ["9000000000.00", "9000000000.01", "9000000000.02", "9000000000.03"]
    star = tiny_star(spark, [(1, 2024, "pim", a) for a in amounts], PLACES)
    row = aggregate(star, {"v": Measure("variance"), "n": Measure("count")}, by).first()
    assert row.v == pytest.approx(1.6667e-4, rel=0.01) and row.n == 4


@pytest.mark.parametrize("spread", [1, 10**6, 10**11, 10**15])
def test_variance_is_exact_at_any_spread(spark, spread):
    pick = random.Random(spread)
    cents = [pick.randrange(-spread, spread) + 999_999_999 for _ in range(300)]
    amounts = [str(Decimal(c) / 100) for c in cents]
    star = tiny_star(spark, [(1 + n % 2, 2024, "pim", a) for n, a in enumerate(amounts)], PLACES)
    mean = Fraction(sum(cents), len(cents))
    wanted = float(sum((c - mean) ** 2 for c in cents) / (len(cents) - 1) / 10_000)
    row = aggregate(star, {"v": Measure("variance"), "d": Measure("stddev")}, {"y": "anio"}).first()
    assert row.v == pytest.approx(wanted, rel=1e-12) and row.d == pytest.approx(row.v**0.5)


def test_variance_is_combined_before_the_join(spark):
    star = tiny_star(spark, [(1, 2024, "pim", "1.00"), (1, 2024, "pim", "2.00")], PLACES)
    text = aggregate(star, {"v": Measure("variance")}, {"d": "departamento_ejecutora_nombre"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [sk_geografia_id" in text[text.index("Join") :]


def test_variance_of_the_largest_amounts(spark):
    star = tiny_star(spark, [(1, 2024, "pim", "9999999999999999.99")] * 200, PLACES)
    assert aggregate(star, {"v": Measure("variance")}, {"y": "anio"}).first().v == pytest.approx(0, abs=100)


def test_label_filters_cut_the_fact_before_it_is_summed(layers):
    text = dashboard.kpis(layers.star, Filters(department="ASIA"))._jdf.queryExecution().optimizedPlan().toString()
    lines = [x.strip(" :+-") for x in text.splitlines()]
    semi = next(i for i, x in enumerate(lines) if x.startswith("Join LeftSemi"))
    assert any(x.startswith("Aggregate [sk_geografia_id") for x in lines[:semi])


def test_lists_are_limited_to_small_domains(star):
    row = aggregate(star, {"a": Measure("array_agg", column="fase")}, {"anio": "anio"}).where(F.col("anio") == 2024).first()
    assert row.a == ["devengado", "girado", "pim"]
    with pytest.raises(ValueError, match="limited"):
        aggregate(star, {"a": Measure("array_agg")})


@pytest.mark.parametrize(
    "by, grain",
    [
        ([], "scalar"),
        (["f.anio"], "year-level"),
        (["p.producto_proyecto_nombre"], "project-level"),
        (["sector_nombre"], "institution-level"),
        (["programa_ppto_nombre"], "program-level"),
        (["producto_proyecto_nombre", "anio"], "project_year-level"),
        (["fi.fuente_financiamiento_nombre"], "financing-level"),
        (["departamento_ejecutora_nombre", "provincia_ejecutora"], "geography-level"),
        (["i.sk_institucion_id", "pliego"], "institution-level"),
        (["funcion", "anio"], "function_year-level"),
        (["actividad_accion_obra", "anio"], "activity_year-level"),
        (["especifica_det"], "economic-level"),
        (["fase"], "unknown-level"),
        (["meta"], "unknown-level"),
    ],
)
def test_valid_groupings(by, grain):
    assert check_request(by)[1] == grain


@pytest.mark.parametrize(
    "by, selected, error",
    [
        (["nonexistent_column"], [], UnknownColumnError),
        (["f.nonexistent_column"], [], UnknownColumnError),
        (["x.monto"], [], UnknownTableError),
        (["g.sector_nombre"], [], UnknownColumnError),
        (["sk_programatica_id"], [], AmbiguousColumnError),
        (["producto_proyecto_nombre"], ["producto_proyecto_nombre", "anio"], UngroupedColumnError),
        ([], ["producto_proyecto_nombre"], UngroupedColumnError),
        (["sector_nombre", "fuente_financiamiento_nombre"], [], MixedGrainError),
        (["sector_nombre", "programa_ppto", "anio"], [], MixedGrainError),
        (["anio", "fase"], [], MixedGrainError),
    ],
)
def test_invalid_groupings(by, selected, error):
    with pytest.raises(error):
        check_request(by, selected)
    assert issubclass(error, GrainError) and issubclass(GrainError, ValueError)


def test_unknown_aggregate_is_refused(star):
    with pytest.raises(GrainError, match="Unknown aggregate"):
        grain_aggregate(star, {"m": Measure("median")}, ["anio"])
    groups, grain = grain_aggregate(star, {"pim": phase_total("pim")}, ["anio"])
    assert grain == grain_of(["anio"]) and groups.count() == 2
