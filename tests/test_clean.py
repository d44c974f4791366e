import pytest

from budgetstar.functions.text import normalise_name
from budgetstar.model import split_cell
from budgetstar.operators.clean import (
    clean_columns,
    clean_fold_accents,
    clean_silver,
    impute_sector,
    union_layers,
)


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("Departamento Ejecutora", "departamento_ejecutora"),
        ("Año Ñ", "ano_n"),
        ("PIM_2024", "pim_2024"),
        ("Función (nombre)", "funcion_nombre"),
        ("a  b\tc", "a_b_c"),
    ],
)
def test_names_are_normalised(raw, plain):
    assert normalise_name(raw) == plain


def test_colliding_names_are_refused(spark):
    with pytest.raises(ValueError, match="collide"):
        clean_columns(spark.createDataFrame([(1, 2)], ["Año", "ano"]))


@pytest.mark.parametrize(
    "column, cell",
    [
        ("comprometido_anual_2024", ("comprometido_anual", 2024)),
        ("comprometido_2024", ("comprometido", 2024)),
        ("pim_2024", ("pim", 2024)),
        ("pim", None),
        ("pim_nombre", None),
        ("tipo_pim_2024", None),
        ("pim_20245", None),
    ],
)
def test_only_phase_year_columns_are_amounts(column, cell):
    assert split_cell(column) == cell


def test_silver_rules(spark):
    raw = spark.createDataFrame(
        [("  lima \t", "1234.567", "n/d"), (" Áncash　", " 10 ", None)],
        ["Departamento Ejecutora", "PIM 2024", "devengado_2024"],
    )
    rows = clean_silver(raw).collect()
    assert [r.departamento_ejecutora for r in rows] == ["LIMA", "ÁNCASH"]
    assert [str(r.pim_2024) for r in rows] == ["1234.57", "10.00"]
    assert [r.devengado_2024 for r in rows] == [None, None]


def test_fold_variant_keeps_other_letters(spark):
    raw = spark.createDataFrame([(" ÁÉÍÓÚ Ñandú ", 5)], "name string, pim_2024 int")
    row = clean_fold_accents(raw).first()
    assert (row.name, row.pim_2024) == ("aeiou ñandu", 5)


def test_missing_and_blank_sectors_get_the_local_government_label(spark):
    raw = spark.createDataFrame([(None, None), (" ", "\t"), ("03", "SALUD")], "sector string, sector_nombre string")
    rows = [tuple(r) for r in impute_sector(raw).collect()]
    default = ("GL", "GOBIERNOS LOCALES (MUNICIPALIDADES)")
    assert rows == [default, default, ("03", "SALUD")]


def test_union_of_deliveries_fills_missing_columns(spark):
    a = spark.createDataFrame([("k", 1)], "key string, pim_2023 int")
    b = spark.createDataFrame([("k", 2)], "key string, pim_2024 int")
    rows = [tuple(r) for r in union_layers([a, b]).select("key", "pim_2023", "pim_2024").collect()]
    assert ("k", 1, None) in rows and ("k", None, 2) in rows
