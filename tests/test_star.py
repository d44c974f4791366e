from decimal import Decimal

import pytest
from conftest import facts, money, tiny_star
from pyspark.sql import functions as F

from budgetstar.functions.keys import surrogate_key
from budgetstar.model import BY_NAME, DIMENSIONS, ENTITY_KEYS, cell_columns
from budgetstar.operators.quality import layer_total
from budgetstar.operators.reshape import pivot_years, unpivot_phases, with_row_key
from budgetstar.operators.star import build_dimension, build_star, fk_orphans, keyed_wide
from budgetstar.sources.fixture import CUTOFF

WIDE = ["key_value", "pia_2024", "pim_2024", "comprometido_2024", "comprometido_anual_2024", "comprometido_anual_2025"]


def test_each_amount_column_is_unpivoted_once(spark):
    wide = money(spark, [("a", 0, 10, 3, 5, None), ("b", 1.5, None, 0, 7, 9)], WIDE)
    rows = sorted((r.key_value, r.anio, r.fase, str(r.monto)) for r in unpivot_phases(wide).collect())
    assert rows == [
        ("a", 2024, "comprometido", "3.00"),
        ("a", 2024, "comprometido_anual", "5.00"),
        ("a", 2024, "pim", "10.00"),
        ("b", 2024, "comprometido_anual", "7.00"),
        ("b", 2024, "pia", "1.50"),
        ("b", 2025, "comprometido_anual", "9.00"),
    ]
    assert layer_total(wide).first().total == Decimal("35.50")


def test_unpivot_generates_only_wanted_cells(spark):
    wide = money(spark, [("a", 1, 2, 3, 4, 5)], WIDE)
    rows = unpivot_phases(wide, years=[2025]).collect()
    assert [(r.fase, r.anio) for r in rows] == [("comprometido_anual", 2025)]
    with pytest.raises(ValueError):
        unpivot_phases(wide, phases=["girado"])


def test_row_key_tells_year_and_phase_apart(spark):
    wide = money(spark, [("a", 1, 2, 3, 4, 5)], WIDE)
    keyed = with_row_key(unpivot_phases(wide))
    assert keyed.select("sk_silver_id").distinct().count() == 5


def test_null_codes_keep_their_position_in_the_key(spark):
    rows = spark.createDataFrame([("A", None, "B"), ("A", "B", None), (None, "A", "B"), ("A", "B", "")], "x string, y string, z string")
    keys = [r[0] for r in rows.select(surrogate_key(["x", "y", "z"])).collect()]
    assert len(set(keys)) == 4 and all(0 <= k < 2**60 for k in keys)


def test_name_variants_resolve_to_one_member(spark):
    d = BY_NAME["geografia"]
    rows = [(7, "01", name, "02", None, "03", "X") for name in ("LIMA", "LIMA METROPOLITANA", "LIMA")]
    rows.append((8, None, "NO CODE", "02", None, "03", "X"))
    for parts in (1, 7):
        members = build_dimension(spark.createDataFrame(rows, d.schema).repartition(parts), d).collect()
        assert [(m.sk_geografia_id, m.departamento_ejecutora_nombre) for m in members] == [(7, "LIMA")]


def test_records_without_amounts_add_no_member(spark, layers):
    silver = layers.silver.drop(*ENTITY_KEYS, "has_amount").limit(50)
    emptied = silver.withColumns({c: F.lit(0).cast("decimal(18,2)") for c in cell_columns(silver.columns)})
    star = build_star(keyed_wide(emptied), CUTOFF)
    assert star.fact.count() == 0 and all(d.count() == 0 for d in star.dims.values())


def test_money_is_equal_in_wide_long_and_fact(layers):
    wide = layer_total(layers.wide).first().total
    long = layer_total(unpivot_phases(layers.wide, ids=["key_value"])).first().total
    assert wide == long == layer_total(layers.star.fact).first().total


def test_one_row_per_key_and_no_orphans(layers):
    star = layers.star
    for d in DIMENSIONS:
        table = star.dim(d.name)
        assert table.count() == table.select(d.key).distinct().count()
    assert all(r.orphan_keys == 0 and r.fact_keys == r.dim_keys for r in fk_orphans(star).collect())


def test_orphans_are_counted(spark):
    star = tiny_star(spark, [(1, 2024, "pim", 5), (9, 2024, "pim", 5), (9, 2023, "pim", 5)], [(1, "LIMA"), (2, "CUSCO")])
    row = next(r for r in fk_orphans(star).collect() if r.key_name == "sk_geografia_id")
    assert (row.fact_keys, row.dim_keys, row.orphan_keys, row.orphan_rows) == (2, 2, 1, 2)


def test_pivot_fills_missing_cells(spark):
    table = spark.createDataFrame([("A", 2023, 1.5), ("B", 2024, 2.5)], "department string, fiscal_year int, v double")
    rows = [tuple(r) for r in pivot_years(table, "department", "fiscal_year", "v", [2023, 2024]).collect()]
    assert rows == [("B", 0.0, 2.5), ("A", 1.5, 0.0)]


def test_layers_do_not_depend_on_partition_count(spark, layers):
    from budgetstar.operators.quality import run_drift, snapshot

    silver = layers.silver
    first = snapshot(build_star(silver.repartition(1), CUTOFF).tables())
    second = snapshot(build_star(silver.repartition(7), CUTOFF).tables())
    assert all(r.passed for r in run_drift(first, second).collect())
    assert facts(spark, [(1, 2024, "pim", 1)]).count() == 1
