import json
import math
import random

import pytest

from budgetstar.operators.logs import (
    audit_query_log,
    trace_failures,
    trace_group_fields,
    trace_stage_stats,
    trace_stage_stats_approx,
)
from budgetstar.operators.questions import GRAIN_WORDS, tag_question_grain
from budgetstar.streaming.traces import read_trace_stream, stage_percentiles, write_band_counts, write_stage_counts


def tag(spark, question, **options):
    return tag_question_grain(spark.createDataFrame([(question,)], "question string"), **options).first()


@pytest.mark.parametrize(
    "question, grain",
    [
        ("Show PIM by department for 2024", "geography-level"),
        ("What is the budget by financing source?", "financing-level"),
        ("Budget by economic category", "economic-level"),
        ("Compare PIM by sector", "institution-level"),
        ("Top programs by PIM", "program-level"),
        ("Which projects have the highest budget?", "project-level"),
        ("Show PIM by department by year", "geography_year-level"),
        ("Presupuesto por departamento por año", "geography_year-level"),
        ("Budget by activities", "activity-level"),
        ("PIM by government functions", "function-level"),
        ("Show budget trends over time", "year-level"),
        ("What was the total PIM for 2024?", "scalar"),
        ("", "scalar"),
        ("   ", "scalar"),
        (None, "scalar"),
        ("Regional budget", "institution-level"),
        ("tipo de recurso", "financing-level"),
        ("GASTO GENÉRICA", "economic-level"),
        ("Spending by department, by year.", "geography_year-level"),
        ("serie de tiempo del gasto", "year-level"),
    ],
)
def test_single_grain_questions(spark, question, grain):
    row = tag(spark, question)
    assert row.composite_grain == grain and row.is_valid and not row.needs_decomposition
    if grain != "scalar":
        assert grain in row.constraint and "GROUP BY" in row.constraint
    else:
        assert row.constraint.startswith("Aggregate all rows")


@pytest.mark.parametrize("family", [g for g in GRAIN_WORDS if g != "year-level"])
def test_every_family_combines_with_the_year(spark, family):
    word = {"economic-level": "economic category", "financing-level": "financing source"}.get(family, family.removesuffix("-level"))
    word = {"geography": "department", "institution": "sector"}.get(word, word)
    assert tag(spark, f"Show PIM by {word} by year").composite_grain == family.replace("-level", "_year-level")


@pytest.mark.parametrize(
    "question, grains",
    [
        ("Show PIM by department and financing source for 2024", {"geography-level", "financing-level"}),
        ("Show PIM by economic category and financing source annually", {"economic-level", "financing-level", "year-level"}),
        ("presupuesto por sectores y departamentos", {"institution-level", "geography-level"}),
        ("Budget by sectors and departments", {"institution-level", "geography-level"}),
    ],
)
def test_several_families_need_decomposition(spark, question, grains):
    row = tag(spark, question)
    assert set(row.detected_grains.split(",")) == grains and row.primary_grain is None
    assert row.needs_decomposition and "multiple dimension families" in row.constraint


def test_punctuation_can_be_kept(spark):
    assert tag(spark, "PIM by department?").primary_grain == "geography-level"
    assert tag(spark, "PIM by department?", strip_punctuation=False).primary_grain == "scalar"


def test_tagging_moves_no_rows(layers):
    from budgetstar.sources.fixture import question_table

    questions = question_table(layers.spark, layers.source)
    before = questions._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert tag_question_grain(questions)._jdf.queryExecution().executedPlan().toString().count("Exchange") == before


@pytest.mark.parametrize(
    "sql, verdict",
    [
        ("SELECT 1", "accepted"),
        ("SELECT 1;", "accepted"),
        ("SELECT 1; -- done", "accepted"),
        ("  with x as (select 1) select * from x", "accepted"),
        ("SELECT 'it''s; a DROP' FROM t", "accepted"),
        ("SELECT a /* drop; this */ FROM t -- delete", "accepted"),
        ("DELETE FROM t", "not_select"),
        ("SELECT 1; DROP TABLE x", "not_single_statement"),
        ("", "not_single_statement"),
        (None, "not_single_statement"),
        ("WITH x AS (DELETE FROM t) SELECT * FROM x", "forbidden_keyword"),
        ("select replace(a, 'x', 'y') from t", "forbidden_keyword"),
        ("SELECT dropped, created_at FROM t", "accepted"),
        ("(SELECT 1)", "not_select"),
        ("SELECT `delete` FROM t", "accepted"),
        ("SELECT '" + "x" * 200_000 + "' FROM t", "accepted"),
        ("SELECT 1 /*" + "*" * 100_000 + "*/", "accepted"),
    ],
)
def test_query_audit(spark, sql, verdict):
    row = audit_query_log(spark.createDataFrame([(sql,)], "sql string")).first()
    assert (row.verdict, row.is_accepted) == (verdict, verdict == "accepted")


@pytest.mark.parametrize(
    "sql, fields",
    [
        ("SELECT a, sum(b) FROM t GROUP BY a, 2, t.c ORDER BY 1", "a|t.c"),
        ("select a from t group\n by a HAVING count(*) > 1", "a"),
        ("SELECT 1", ""),
        ("SELECT a FROM t GROUP BY 1, 2", ""),
        ("SELECT a FROM t GROUP BY a LIMIT 5;", "a"),
        ("select a from t group by a order by a", "a"),
        ("WITH x AS (SELECT a, sum(b) s FROM t GROUP BY a) SELECT * FROM x WHERE s > 1", "a"),
        ("SELECT 1 FROM t GROUP BY date_trunc('y', d), e HAVING count(*) > 1", "date_trunc('y', d)|e"),
        ("SELECT 'GROUP BY z' FROM t GROUP BY `order`, a -- , b", "`order`|a"),
        ("SELECT a FROM t GROUP BY a + 1, t.b UNION ALL SELECT 2", "a+1|t.b"),
        (None, ""),
    ],
)
def test_group_fields(spark, sql, fields):
    assert trace_group_fields(spark.createDataFrame([(sql,)], "sql string")).first().group_fields == fields


def _trace(stage, ms, status="succeeded", rows=1, failure=None, session="s"):
    return json.dumps(
        {
            "trace": "t",
            "session_id": session,
            "row_count_result": rows,
            "sql_execution_status": "success" if failure is None else "failed",
            "failure_type": failure,
            "stages": [{"stage": stage, "status": status, "duration_ms": ms}],
        }
    )


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_against_sorting(spark, seed):
    rng = random.Random(seed)
    values = [round(rng.choice([rng.uniform(0, 1), rng.uniform(0, 5000), 12.5, 0.0]), 2) for _ in range(rng.randint(1, 400))]
    log = spark.createDataFrame([(_trace("SQL_EXECUTION", v),) for v in values], "payload string")
    row = trace_stage_stats(log, (50, 90, 95, 100)).first()
    ranked = sorted(values)
    for p in (50, 90, 95, 100):
        assert row[f"p{p}_ms"] == ranked[math.ceil(len(values) * p / 100) - 1]
    assert row.avg_ms == pytest.approx(sum(values) / len(values))
    near, slack = trace_stage_stats_approx(log, (50, 95)).first(), 1  # ranks, with so few values
    for p in (50, 95):
        rank = math.ceil(len(values) * p / 100) - 1
        assert ranked[max(0, rank - slack)] <= near[f"p{p}_ms"] <= ranked[min(len(ranked) - 1, rank + slack)]


def test_stage_without_durations_and_broken_lines(spark):
    log = spark.createDataFrame([(_trace("FAILED", None, "failed"),), ("no json",), (None,)], "payload string")
    rows = [tuple(r) for r in trace_stage_stats(log).collect()]
    assert rows == [("FAILED", 1, 1, None, None, None, None)]


def test_failures_and_empty_results(spark):
    lines = [
        _trace("SQL_EXECUTION", 1.0, failure="SQL_SYNTAX_ERROR", session="a"),
        _trace("SQL_EXECUTION", 1.0, failure="SQL_SYNTAX_ERROR", session="a", rows=0),
        _trace("SQL_EXECUTION", 1.0, rows=0, session="b"),
        _trace("SQL_EXECUTION", 1.0),
    ]
    rows = [tuple(r) for r in trace_failures(spark.createDataFrame([(x,) for x in lines], "payload string")).collect()]
    assert rows == [("EMPTY_RESULT_SET", 1, 1), ("SQL_SYNTAX_ERROR", 2, 1)]


def test_trace_stream_counts_new_files_only_once(spark, tmp_path):
    source, target, marks = (tmp_path / n for n in ("logs", "out", "marks"))
    source.mkdir()

    def run(name, *lines):
        (source / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
        write_stage_counts(read_trace_stream(spark, str(source)), str(target), str(marks)).awaitTermination(120)
        return sorted((r.stage, r.runs, r.failed, float(r.total_ms)) for r in spark.read.parquet(str(target)).collect())

    assert run("a.json", _trace("A", 1.5), _trace("B", 2.0, "failed")) == [("A", 1, 0, 1.5), ("B", 1, 1, 2.0)]
    assert run("b.json", _trace("A", 0.25)) == [("A", 2, 0, 1.75), ("B", 1, 1, 2.0)]


def test_percentiles_of_the_stream_bound_the_exact_ones(spark, tmp_path):
    source, target, marks = (tmp_path / n for n in ("logs", "out", "marks"))
    source.mkdir()
    pick, lines = random.Random(4), []
    for part in range(3):
        new = [_trace(pick.choice("AB"), round(pick.expovariate(0.01), 2), pick.choice(["ok", "failed"])) for _ in range(150)]
        new += [_trace("C", None), _trace("A", 0.0)]
        (source / f"{part}.json").write_text("\n".join(new) + "\n", encoding="utf-8")
        lines += new
        write_band_counts(read_trace_stream(spark, str(source)), str(target), str(marks)).awaitTermination(120)
    got = {r.stage: r for r in stage_percentiles(spark.read.parquet(str(target)), (50, 95)).collect()}
    exact = trace_stage_stats(spark.createDataFrame([(x,) for x in lines], "payload string")).collect()
    assert set(got) == {r.stage for r in exact} == {"A", "B", "C"}
    for r in exact:
        mine = got[r.stage]
        assert (mine.runs, mine.failed, mine.max_ms) == (r.runs, r.failed, r.max_ms)
        for p in (50, 95):
            if r[f"p{p}_ms"] is None:
                assert mine[f"p{p}_band"] is None
            else:
                assert mine[f"p{p}_low"] <= r[f"p{p}_ms"] <= mine[f"p{p}_high"]
