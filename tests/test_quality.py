from decimal import Decimal

import pytest
from conftest import money, tiny_star
from pyspark.sql import functions as F

from budgetstar.functions.money import currency_label, execution_tier, percent_text, target_gap
from budgetstar.operators import quality
from budgetstar.operators.reshape import unpivot_phases


def amounts(spark, *values):
    return money(spark, [(v,) for v in values], ["monto"])


def test_equal_totals_pass(spark):
    silver, gold = amounts(spark, 100.0, 250.25, 150.25), amounts(spark, 300.0, 200.50)
    quality.require_reconciled(silver, gold)
    assert quality.reconcile_total(silver, gold).first().passed


def test_different_totals_raise(spark):
    silver, gold = amounts(spark, 100.0, 250.25, 150.25), amounts(spark, 300.0, 200.55)
    with pytest.raises(ValueError, match="Data quality audit failed. Financial mismatch detected: S/. 0.05"):
        quality.require_reconciled(silver, gold)


def test_one_cent_is_tolerated(spark):
    assert quality.reconcile_total(amounts(spark, 1.00), amounts(spark, 1.01)).first().passed
    assert not quality.reconcile_total(amounts(spark, 1.00), amounts(spark, 1.02)).first().passed


WIDE = ["key_value", "name", "pim_2023", "pim_2024", "devengado_2024"]
RECORDS = [("a", "x", 1, 2, 3), ("a", "y", 1, None, 3), ("b", "x", 5, 0, 0), ("c", "x", 9, 9, 9), ("c", "x", 9, 9, 9), ("d", None, -1, 0, 2), ("d", "x", 1, 0, 2)]


@pytest.fixture()
def wide(spark):
    return money(spark, RECORDS, WIDE)


def test_breaks_per_year_and_phase(spark, wide):
    fact = unpivot_phases(wide).where(~((F.col("fase") == "pim") & (F.col("anio") == 2024)))
    for silver in (wide, unpivot_phases(wide)):
        rows = {(r.anio, r.fase): r for r in quality.reconcile_by_year_phase(silver, fact).collect()}
        assert [k for k, r in rows.items() if r.is_break] == [(2024, "pim")]
        assert rows[(2024, "pim")].diferencia == 20.0
    assert not quality.reconcile_total(wide, fact).first().passed


def test_volumes(wide):
    long = unpivot_phases(wide)
    row = quality.volumetrics(wide, long).first()
    assert tuple(row) == (21, 16, 5, 16, 0)
    assert quality.volumetrics(wide, long.limit(10)).first().unexplained_gap == 6
    assert tuple(quality.volumetrics(long, long).first()) == (16, 16, 0, 16, 0)


def test_key_audits(wide):
    assert tuple(quality.key_uniqueness(wide).first()) == (7, 4, 3, False)
    assert sorted((r.key_value, r.repetitions) for r in quality.duplicate_keys(wide).collect()) == [("a", 2), ("c", 2), ("d", 2)]


def test_repeated_keys(wide):
    diff = {r.key_value: r.differing_columns for r in quality.duplicate_key_diff(wide).collect()}
    assert diff == {"a": "name,pim_2024", "c": "", "d": "name,pim_2023"}
    sums = sorted((r.key_value, r.column_name, r.total) for r in quality.duplicate_key_amounts(wide).collect())
    assert sums == [
        ("a", "devengado_2024", 6.0),
        ("a", "pim_2023", 2.0),
        ("a", "pim_2024", 2.0),
        ("c", "devengado_2024", 18.0),
        ("c", "pim_2023", 18.0),
        ("c", "pim_2024", 18.0),
        ("d", "devengado_2024", 4.0),
    ]


def test_one_key_with_most_rows(spark):
    rows = [("hot", str(i % 3), 1, 1, 1) for i in range(500)] + [(f"k{i}", "x", 1, 1, 1) for i in range(300)]
    table = money(spark, rows, WIDE).repartition(5)
    assert [tuple(r) for r in quality.duplicate_key_diff(table).collect()] == [("hot", 500, 1, "name")]


def test_drift_is_found(spark):
    a = tiny_star(spark, [(1, 2024, "pim", 5), (2, 2024, "pim", 6)], [(1, "LIMA")]).tables()
    moved = tiny_star(spark, [(1, 2024, "pim", 6), (2, 2024, "pim", 5)], [(1, "LIMA")]).tables()
    renamed = tiny_star(spark, [(2, 2024, "pim", 6), (1, 2024, "pim", 5)], [(1, "CUSCO")]).tables()
    quality.require_no_drift(quality.run_drift(quality.snapshot(a), quality.snapshot(a)))
    with pytest.raises(RuntimeError, match="fact_presupuesto"):
        quality.require_no_drift(quality.run_drift(quality.snapshot(a), quality.snapshot(moved)))
    with pytest.raises(RuntimeError, match="not deterministic: dim_geografia$"):
        quality.require_no_drift(quality.run_drift(quality.snapshot(a), quality.snapshot(renamed)))


def test_storage_counts_rows_of_stored_files(spark, layers):
    rows = {r.layer: r for r in quality.layer_storage({n: spark.read.parquet(p) for n, p in layers.folders().items()}).collect()}
    assert rows["gold/fact_presupuesto"].rows == layers.star.fact.count()
    assert rows["source/lineitem"].files == 1 and rows["source/lineitem"].bytes > 0


def test_one_key_with_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key_value"),
        F.when(F.col("id") == 17, F.lit(None)).otherwise(F.lit("same")).alias("name"),
        F.lit("x").alias("other"),
        F.lit(1).cast("decimal(18,2)").alias("pim_2024"),
    )
    found = quality.duplicate_key_diff(rows).collect()
    assert [tuple(r) for r in found] == [("hot", 1000, 1, "name")]
    assert [tuple(r) for r in quality.duplicate_key_amounts(rows).collect()] == [("hot", "pim_2024", 1000.0)]


def scans(frame, column):
    """File scans of the physical plan that read a column."""
    text = frame._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in line and column in line.split("ReadSchema")[-1] for line in text.splitlines())


def test_audits_read_the_fact_once(layers):
    from budgetstar.operators.star import fk_orphans

    assert scans(fk_orphans(layers.star), "sk_geografia_id:bigint,sk_institucion_id") == 1
    assert scans(quality.table_audit(layers.star), "sk_geografia_id:bigint,sk_institucion_id") <= 2
    assert scans(quality.sample_gates(layers.star, 10), "monto") == 0  # reads the written summary only


def test_preview_is_the_same_on_every_run(spark, layers):
    first = [r.value for r in quality.preview(layers.star.fact, 5).collect()]
    assert first == [r.value for r in quality.preview(layers.star.fact.repartition(7), 5).collect()] and len(first) == 5


def test_year_range_and_preview(spark):
    star = tiny_star(spark, [(1, 2022, "pim", 5), (1, 2025, "pim", 6)], [(1, "LIMA")])
    assert tuple(quality.fact_year_range(star.fact).first()) == (2022, 2025)
    assert quality.preview(star.fact, 1).count() == 1


@pytest.mark.parametrize(
    "amount, label",
    [
        ("1234567890123.45", "S/. 1.23 T"),
        ("5373286978810.52", "S/. 5.37 T"),
        ("2500000000", "S/. 2.50 B"),
        ("-1500000", "S/. -1.50 M"),
        ("999999.99", "S/. 999,999.99"),
        ("0", "S/. 0.00"),
    ],
)
def test_currency_labels(spark, amount, label):
    table = spark.createDataFrame([(Decimal(amount),)], "a decimal(28,2)")
    assert table.select(currency_label(F.col("a"))).first()[0] == label


@pytest.mark.parametrize("rate, tier", [(75.0, "success"), (74.9, "warning"), (40.0, "warning"), (39.99, "danger")])
def test_execution_tiers(spark, rate, tier):
    row = spark.createDataFrame([(rate,)], "r double").select(execution_tier(F.col("r")), target_gap(F.col("r"))).first()
    assert row[0] == tier and row[1] == pytest.approx(rate - 75.0)


def test_percent_text_drops_one_trailing_zero(spark):
    table = spark.createDataFrame([(Decimal(1), Decimal(3)), (Decimal(1), Decimal(2)), (Decimal(1), Decimal(0))], "a decimal(18,2), b decimal(18,2)")
    assert [r[0] for r in table.select(percent_text(F.col("a"), F.col("b"))).collect()] == ["33.33 %", "50.0 %", None]


def test_drift_names_rows_with_their_number(spark):
    rows = [(i, f"name {i}") for i in range(300)]
    a = spark.createDataFrame([*rows, (1, "name 1"), (2, None)], "k int, name string")
    b = spark.createDataFrame([*rows[1:], (2, "x|y"), (2, "x|y")], "k int, name string")
    alone = spark.createDataFrame([(7,)], "k int")
    for ranges in (1, 16, 1 << 14):
        found = quality.drift_rows({"t": a, "u": alone}, {"t": b}, ranges)
        got = sorted((r.table_name, r.side, r.row, r.n) for r in found.collect())
        wanted = [("t", "first", "0|name 0", 1), ("t", "first", "1|name 1", 1), ("t", "first", "2|~", 1), ("t", "second", "2|x|y", 2), ("u", "first", "7", 1)]
        assert got == wanted
    assert quality.drift_rows({"t": a}, {"t": a}).count() == 0
    with pytest.raises(ValueError, match="other columns"):
        quality.drift_rows({"t": a}, {"t": alone})
