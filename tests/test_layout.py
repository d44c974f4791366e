"""What building the layers leaves on disk, and that slices and layout change no row."""

import time

import pytest
from conftest import SMALL, money
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from budgetstar.model import DIMENSIONS
from budgetstar.operators.star import build_star, keyed_wide
from budgetstar.plans.layers import Layers
from budgetstar.sources import fixture
from budgetstar.sources.parquet import write_layer, write_star
from budgetstar.sources.shared import WRITE_SETTINGS


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.length()))


def left_behind(spark, before, seconds=20):
    """Shuffle files more than ``before``; they are removed by messages, so they may take a moment."""
    end = time.monotonic() + seconds
    while (more := shuffle_files(spark) - before) > 0 and time.monotonic() < end:
        time.sleep(0.2)
    return max(0, more)


def same_rows(a, b):
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_written_layer_leaves_no_shuffle_files(spark, tmp_path):
    rows = spark.range(1000, numPartitions=4).select(F.col("id"), (F.col("id") % 7).alias("k"))
    before = shuffle_files(spark)
    write_layer(rows.repartition(5, "k"), str(tmp_path / "layer"))
    assert left_behind(spark, before) == 0
    assert spark.read.parquet(str(tmp_path / "layer")).count() == 1000


def test_settings_of_a_write_end_with_it(spark, tmp_path, monkeypatch):
    keys = [*WRITE_SETTINGS, "spark.sql.maxConcurrentOutputFileWriters"]
    before, held = {k: spark.conf.get(k, None) for k in keys}, {}

    def failing(self, path):
        held.update({k: spark.conf.get(k, None) for k in keys})
        raise RuntimeError("no room")

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(RuntimeError, match="no room"):
        write_layer(spark.range(3), str(tmp_path / "layer"), partition_by=["id"])
    assert held.items() >= WRITE_SETTINGS.items() and int(held[keys[-1]]) > 0
    assert {k: spark.conf.get(k, None) for k in keys} == before


@pytest.mark.parametrize("slice_bytes", [1 << 16, 1 << 10])
def test_slices_hold_each_record_once(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(fixture, "SLICE_BYTES", slice_bytes)
    slices = fixture.budget_slices(spark, SMALL)
    assert 1 < len(slices) <= fixture.SLICES
    whole = slices[0]
    for other in slices[1:]:
        assert whole.columns == other.columns and not other.isEmpty()
        whole = whole.unionByName(other)
    assert same_rows(whole, fixture.wide_budget(spark, SMALL))


def test_small_tables_are_one_slice(spark):
    assert len(fixture.budget_slices(spark, SMALL)) == 1


def test_layers_do_not_depend_on_slices(spark, layers, monkeypatch):
    monkeypatch.setattr(fixture, "SLICE_BYTES", 1 << 10)
    sliced = Layers(spark, SMALL, run="slices")
    assert same_rows(sliced.silver, layers.silver)
    for (_, a), (_, b) in zip(sliced.star.tables().items(), layers.star.tables().items(), strict=True):
        assert same_rows(a, b)


@pytest.fixture()
def odd_source(spark, tmp_path):
    """Repeated orders, keys that are null or meet nothing, null flags and line numbers."""
    folder = str(tmp_path / "odd")
    for name in fixture.TABLES:
        rows = fixture.table(spark, SMALL, name)
        if name == "lineitem":
            key = F.when(F.col("l_orderkey") % 11 == 0, None).when(F.col("l_orderkey") % 13 == 0, -F.col("l_orderkey"))
            rows = rows.withColumn("l_orderkey", key.otherwise(F.col("l_orderkey")))
            for column, step in (("l_returnflag", 5), ("l_linestatus", 7), ("l_linenumber", 9), ("l_shipdate", 17), ("l_discount", 19)):
                rows = rows.withColumn(column, F.when(F.pmod(F.xxhash64("l_orderkey", "l_partkey"), F.lit(step)) != 0, F.col(column)))
        if name == "orders":
            rows = rows.unionByName(rows.where(F.col("o_orderkey") % 10 == 0))
            rows = rows.withColumn("o_custkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey")))
        rows.write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_amounts_follow_the_rule_of_each_phase(spark, odd_source):
    """Every cell against the phases written out one by one, on rows with nulls and repeated keys."""
    line = fixture.table(spark, odd_source, "lineitem")
    orders = fixture.table(spark, odd_source, "orders").where("o_custkey IS NOT NULL")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    net = "CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(1,0)) - CAST(l_discount AS DECIMAL(4,2)))"
    phases = {
        "pia": "CASE WHEN l_linenumber % 3 = 0 THEN 0.00 ELSE CAST(l_extendedprice AS DECIMAL(12,2)) * 0.90 END",
        "pim": "CAST(l_extendedprice AS DECIMAL(12,2))",
        "certificado": f"CASE WHEN l_returnflag <> 'N' THEN {net} END",
        "comprometido_anual": net,
        "comprometido": f"{net} * 0.95",
        "devengado": f"CASE WHEN l_linestatus = 'F' THEN {net} ELSE {net} * 0.50 END",
        "girado": f"CASE WHEN l_linestatus = 'F' THEN {net} END",
    }
    share = "CASE WHEN year(l_shipdate) = {0} THEN 1.00 WHEN year(l_shipdate) + 1 = {0} AND l_linenumber % 2 = 1 THEN 0.50 END"
    cells = [
        f"CAST(CAST({phase} AS DECIMAL(18,6)) * ({share.format(year)}) AS DECIMAL(18,2)) AS {name}_{year}"
        for name, phase in phases.items()
        for year in fixture.YEARS
    ]
    key = "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)) AS key_value"
    wanted = joined.selectExpr(key, "CAST(l_partkey AS STRING) AS producto_proyecto", *cells)
    found = fixture.wide_budget(spark, odd_source).select(*wanted.columns)
    assert not wanted.isEmpty() and same_rows(found, wanted)


def test_odd_rows_are_the_same_in_slices(spark, odd_source, monkeypatch):
    whole = fixture.wide_budget(spark, odd_source)
    monkeypatch.setattr(fixture, "SLICE_BYTES", 1 << 12)
    slices = fixture.budget_slices(spark, odd_source)
    union = slices[0]
    for other in slices[1:]:
        union = union.unionByName(other)
    assert len(slices) > 1 and same_rows(union, whole)


def test_facts_are_written_where_they_are_unpivoted(spark, layers, tmp_path):
    """Phases of a record stay together in the files, and nothing is moved or left in a shuffle."""
    before = shuffle_files(spark)
    keyed = layers.silver.coalesce(2)
    star = write_star(build_star(keyed), str(tmp_path / "gold"))
    assert left_behind(spark, before) == 0
    files = sorted((tmp_path / "gold" / "fact_presupuesto").glob("anio=1998/*.parquet"))
    assert 1 <= len(files) <= 2  # one for each task at most
    phases = [r.fase for r in spark.read.parquet(str(files[0])).coalesce(1).collect()]
    runs = sum(a != b for a, b in zip(phases, phases[1:]))
    assert runs > len(phases) / 2
    assert same_rows(star.fact, layers.star.fact)


def test_more_years_than_open_files(spark, tmp_path):
    years = range(2000, 2040)
    wide = money(spark, [(f"r{i}", *[i + y for y in years]) for i in range(30)], ["key_value", *[f"pim_{y}" for y in years]])
    codes = {c: F.col("key_value") for d in DIMENSIONS for c in d.columns}
    star = write_star(build_star(keyed_wide(wide.withColumns(codes)), 2100), str(tmp_path / "gold"))
    assert {(r.anio, r["count"]) for r in star.fact.groupBy("anio").count().collect()} == {(y, 30) for y in years}
    assert star.fact.agg(F.sum("monto")).first()[0] == sum(i + y for i in range(30) for y in years)
