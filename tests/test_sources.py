import csv
import random
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetstar.model import cell_columns
from budgetstar.operators import sampling
from budgetstar.plans.pipeline import executive_reports, run_pipeline
from budgetstar.sources import bronze, fixture
from budgetstar.sources.bronze import (
    UnknownColumnsError,
    apply_dictionary,
    ingest_csv,
    scan_csv,
    schema_from_dictionary,
)
from budgetstar.sources.parquet import open_star, read_layer, read_star, write_star
from budgetstar.streaming.ingest import ingest_incremental


def test_csv_round_trip_strips_headers_and_keeps_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" KEY_VALUE , Sector \n001, x \n002,\n", encoding="utf-8")
    table = ingest_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "bronze"))
    assert table.columns == ["KEY_VALUE", "Sector"]
    assert sorted(tuple(r) for r in table.collect()) == [("001", " x "), ("002", None)]


def test_csv_glob_reads_all_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part_{i}.csv").write_text(f"k,v\n{i},x\n", encoding="utf-8")
    assert scan_csv(spark, str(tmp_path / "part_*.csv")).count() == 3


def test_missing_files_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        read_layer(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        open_star(spark, str(tmp_path))


def test_dictionary_forces_text(spark):
    words = spark.createDataFrame([("code", " Carácter "), ("amount", "Numérico")], "VARIABLE string, TIPO_DATO string")
    assert schema_from_dictionary(words, ["code", "amount"]).simpleString() == "struct<code:string,amount:decimal(18,2)>"
    source = spark.createDataFrame([("007", "1.5"), ("008", "x")], "code string, amount string")
    assert [tuple(r) for r in apply_dictionary(source, words).collect()] == [("007", Decimal("1.50")), ("008", None)]


def test_dictionary_schema_on_read_is_permissive(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,amount\n007,1.5\n008,x\n", encoding="utf-8")
    words = spark.createDataFrame([("code", "Carácter")], "VARIABLE string, TIPO_DATO string")
    table = scan_csv(spark, str(tmp_path / "a.csv"), schema_from_dictionary(words, ["code", "amount"]))
    assert [tuple(r) for r in table.collect()] == [("007", Decimal("1.50")), ("008", None)]


def test_star_round_trip_and_views(spark, layers, tmp_path):
    folder = str(tmp_path / "gold")
    write_star(layers.star, folder)
    assert "anio=1998" in {p.name for p in (tmp_path / "gold" / "fact_presupuesto").iterdir()}
    star = open_star(spark, folder)
    assert star.fact.schema == layers.star.fact.schema
    assert spark.sql("SELECT count(*) FROM fact_presupuesto").first()[0] == layers.star.fact.count()
    with pytest.raises(Exception, match="(?i)already exists"):
        write_star(layers.star, folder)


def test_quoted_line_breaks_and_quotes_stay_in_their_field(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"two\nlines"\n2,"say ""hi"""\n', encoding="utf-8")
    assert sorted(tuple(r) for r in scan_csv(spark, str(tmp_path / "a.csv")).collect()) == [("1", "two\nlines"), ("2", 'say "hi"')]


def test_columns_meet_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("v,k\ny,2\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("extra,k,v\ne,3,z\n", encoding="utf-8")
    table = scan_csv(spark, str(tmp_path))
    assert sorted((r.k, r.v, r.extra) for r in table.collect()) == [("1", "x", None), ("2", "y", None), ("3", "z", "e")]
    with pytest.raises(UnknownColumnsError, match="c.csv: extra"):
        scan_csv(spark, str(tmp_path), KEY_AND_VALUE)
    part = scan_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], KEY_AND_VALUE)
    assert sorted(tuple(r) for r in part.collect()) == [("1", "x"), ("2", "y")]


PARTS = ["a", "", "x,y", 'say "hi"', "two\nlines", "\n\n", '5" pipe', ",", '"', "end\r\nof", "plain text", '"\n"', "é\n", "lone\rend"]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    """Splits of a few hundred bytes start and end anywhere, inside quoted fields too."""
    pick = random.Random(1)
    rows = [[str(i)] + [pick.choice(PARTS) for _ in range(4)] for i in range(150)]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["k", "a", " b ", "c", "d"])
        writer.writerows(rows)
    (tmp_path / "b.csv").write_text('d,k,a\n5" x,900,plain\nq,901,"z"\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text('k,"a\nb"\n1000,"u\nv"\n', encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(s) for s in sizes]
    try:
        for name, value in zip(sizes, ("700", "1")):
            spark.conf.set(name, value)
        lines = bronze._lines(spark, str(tmp_path / "a.csv"))
        assert lines.select("start").distinct().count() > 3
        table = scan_csv(spark, str(tmp_path))
        got = {r.k: r for r in table.collect()}
        files = bronze.inspect_files(spark, str(tmp_path))
    finally:
        for name, value in zip(sizes, before):
            spark.conf.set(name, value)
    assert table.columns == ["d", "k", "a", "b", "c", "a\nb"] and len(got) == len(rows) + 3
    assert [f.broken for f in files] == [True, False, True]
    for row in rows:
        assert [got[row[0]][c] for c in "abcd"] == [v or None for v in row[1:]]
    assert (got["900"].d, got["901"].a, got["1000"]["a\nb"]) == ('5" x', "z", "u\nv")


def test_an_open_quote_ends_with_its_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"open\n2,x\n3,y\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("k,v\n4,z\n", encoding="utf-8")
    got = sorted((r.k, r.v) for r in scan_csv(spark, str(tmp_path)).collect())
    assert got[0][0] == "1" and got[0][1].startswith("open") and got[1:] == [("4", "z")]


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}.csv").write_text("k,v\n1,x\n" if i % 2 else "v,k\nx,1\n", encoding="utf-8")
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        files = bronze.inspect_files(spark, str(tmp_path))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(files) == 60 and {f.header for f in files} == {("k", "v"), ("v", "k")}
    assert len(jobs) <= 3  # the listing of many paths may be one of them


def test_rejected_values_are_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,amount\n1,1.5\n2,"n/d\nx"\n3,\n4,1e99\n', encoding="utf-8")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("amount", T.DecimalType(18, 2))])
    bad = sorted(tuple(r) for r in bronze.rejected_values(spark, str(tmp_path), schema, ["k"]).collect())
    assert bad == [("2", "amount", "n/d\nx"), ("4", "amount", "1e99")]
    read = scan_csv(spark, str(tmp_path), schema)
    assert read.where("amount IS NOT NULL").count() + len(bad) + 1 == 4  # one is missing
    only_text = T.StructType([T.StructField(c, T.StringType()) for c in ("k", "amount")])
    assert bronze.rejected_values(spark, str(tmp_path), only_text, ["k"]).count() == 0


KEY_AND_VALUE = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])


def test_incremental_ingest_reads_each_file_once(spark, tmp_path):
    source, target, marks = (tmp_path / n for n in ("in", "out", "marks"))
    source.mkdir()
    (source / "a.csv").write_text(" k ,v\n1,x\n2,y\n", encoding="utf-8")

    def run():
        ingest_incremental(spark, str(source), str(target), str(marks), KEY_AND_VALUE).awaitTermination(120)
        return sorted((r.k, r.v) for r in spark.read.parquet(str(target)).collect())

    assert run() == [("1", "x"), ("2", "y")]
    assert run() == [("1", "x"), ("2", "y")]
    (source / "b.csv").write_text("v, k\nz,3\n", encoding="utf-8")
    assert run() == [("1", "x"), ("2", "y"), ("3", "z")]
    (source / "c.csv").write_text("extra,k,v\ne,4,w\n", encoding="utf-8")
    with pytest.raises(StreamingQueryException, match="extra"):
        run()
    assert spark.read.parquet(str(target)).count() == 3


def _budget_csv(spark, tmp_path, layers):
    folder = str(tmp_path / "csv")
    layers.wide.limit(400).coalesce(1).write.option("header", True).csv(folder)
    return folder


def test_pipeline_from_csv_to_reports(spark, layers, tmp_path):
    source = _budget_csv(spark, tmp_path, layers)
    result = run_pipeline(spark, source, str(tmp_path / "lake"), cutoff=fixture.CUTOFF)
    volumes = result.volumes.first()
    assert volumes.unexplained_gap == 0 and volumes.silver_rows == 400 * len(cell_columns(layers.wide.columns))
    for report in executive_reports(result.star, fixture.REPORT_YEAR, "ASIA").values():
        assert report.count() > 0
    again = read_star(spark, str(tmp_path / "lake" / "gold"), fixture.CUTOFF)
    assert again.fact.count() == volumes.fact_rows


def test_sample_exports(spark, layers, tmp_path):
    flat = sampling.flat_sample(layers.star, 20)
    sampling.export_csv(flat, str(tmp_path / "flat"))
    back = scan_csv(spark, str(tmp_path / "flat"))
    assert back.count() == 20 and not [c for c in back.columns if c.startswith("sk_")]
    sizes = sampling.entity_sizes(layers.star.fact, [1998])
    chosen = sampling.select_entities(sizes, 100)
    sample = sampling.sample_star(layers.star, chosen, [1998])
    sampling.write_manifest(sampling.sample_manifest(sample, chosen, 100, [1998]), str(tmp_path / "manifest"))
    manifest = spark.read.json(str(tmp_path / "manifest")).first()
    assert manifest.fact_rows == sample.fact.count() and manifest.years == "1998"
    assert sample.fact.where(F.col("anio") != 1998).count() == 0
