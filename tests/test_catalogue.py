"""Registered queries against DuckDB, and the plans they run with."""

import glob
import os
import re

import duckdb
import pytest
from conftest import SMALL

from __spark_entry__ import entry
from budgetstar.operators.aggregate import Filters
from budgetstar.plans import dashboard, reports
from budgetstar.plans.catalogue import QUERIES
from oracles import ORACLES as TWINS



@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(float(f"{r[i]:.12g}") if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    result = duck.execute(TWINS[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    got, want = canonical(frame.collect(), frame.columns), canonical(result.fetchall(), columns)
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    assert entry(spark).count() == 5


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_hold_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert node not in text, f"{name}: {node}"


def test_filters_reach_the_fact_scan(layers):
    text = plan(reports.top_departments(layers.star, 1998))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "monto" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*anio#\d+ = 1998", scan)
    assert "EqualTo(fase,devengado)" in scan
    assert re.search(r"ReadSchema: struct<sk_geografia_id:bigint,fase:string,monto:decimal\(18,2\)>", scan)


def test_the_fact_is_combined_before_it_meets_a_dimension(layers):
    text = plan(dashboard.geographic_heatmap(layers.star, Filters(year=1998)))
    join = text.index("Join")
    assert "HashAggregate(keys=[sk_geografia_id" in text[join:]


def test_the_trend_reads_the_winners_once(layers):
    text = plan(QUERIES["top_project_trend"](layers.spark, layers.source))
    assert "TakeOrderedAndProject" not in text and text.count("BroadcastHashJoin") >= 1


def test_layers_are_built_once_per_session(spark, layers):
    assert layers.gold_folder == type(layers)(spark, SMALL).gold_folder
    assert layers.gold_folder.startswith(spark.conf.get("spark.checkpoint.dir", "/"))


def test_a_cluster_without_a_shared_folder_is_told_so(spark, monkeypatch):
    from types import SimpleNamespace

    from budgetstar.sources.shared import shared_root

    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077")
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(cluster)
