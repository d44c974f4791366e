"""Batch jobs over query logs and execution-trace logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetstar.functions.money import as_double
from budgetstar.functions.text import stripped
from budgetstar.sources.shared import cut_lineage

# Words no logged statement may contain outside literals and comments.
FORBIDDEN_WORDS = (
    "INSERT",
    "UPDATE",
    "DELETE",
    "DROP",
    "ALTER",
    "CREATE",
    "TRUNCATE",
    "EXEC",
    "EXECUTE",
    "CALL",
    "MERGE",
    "REPLACE",
    "GRANT",
    "REVOKE",
    "ATTACH",
    "DETACH",
    "LOAD",
    "INSTALL",
    "COPY",
    "IMPORT",
    "EXPORT",
    "RENAME",
)
READ_WORDS = ("SELECT", "WITH")

# Possessive loops: a long literal costs no stack. Names may stand in double or back quotes.
_LITERAL = r"""'[^']*+(?:''[^']*+)*+'|"[^"]*+(?:""[^"]*+)*+"|`[^`]*+(?:``[^`]*+)*+`"""
_COMMENT = r"--[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"


def without_comments(sql: Column) -> Column:
    return F.regexp_replace(sql, f"({_LITERAL})|{_COMMENT}", "$1 ")


def bare_sql(sql: Column) -> Column:
    """The statement without comments and with literals and quoted names as ``?``."""
    return F.regexp_replace(without_comments(sql), _LITERAL, "?")


def audit_query_log(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds the verdict per logged statement: one statement, reading only, no forbidden word."""
    bared = log.withColumn("_bare", bare_sql(F.coalesce(F.col(sql), F.lit(""))))
    statements = F.size(F.filter(F.split("_bare", ";"), lambda s: stripped(s) != ""))
    first = F.upper(F.regexp_extract("_bare", r"^[\s;]*(\w+)", 1))
    words = F.split(F.upper("_bare"), r"[^A-Z0-9_]+")
    forbidden = F.array_sort(F.array_intersect(words, F.array(*[F.lit(w) for w in FORBIDDEN_WORDS])))
    checked = bared.select(
        *log.columns,
        statements.alias("statements"),
        first.alias("first_word"),
        forbidden.alias("_forbidden"),
    )
    reason = (
        F.when(F.col("statements") != 1, "not_single_statement")
        .when(~F.col("first_word").isin(*READ_WORDS), "not_select")
        .when(F.size("_forbidden") > 0, "forbidden_keyword")
    )
    return checked.select(
        *log.columns,
        "statements",
        F.array_join("_forbidden", ",").alias("forbidden_words"),
        reason.isNull().alias("is_accepted"),
        F.coalesce(reason, F.lit("accepted")).alias("verdict"),
    )


# A token is a literal, a word with its dots, or a single other character; blanks are left out.
_TOKEN = rf"(?:{_LITERAL})|[\w$.]+|[^\s\w$.]"
_CLAUSE_END = ("HAVING", "ORDER", "LIMIT", "QUALIFY", "WINDOW", "UNION", "INTERSECT", "EXCEPT", "FETCH", "OFFSET")


def trace_group_fields(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds the grouped fields named by each statement's first GROUP BY; positions are left out.

    The statement is read as tokens with the depth of their brackets. The clause begins after the
    first GROUP BY and ends with the bracket around it, with a semicolon, or with the next clause at
    its own depth; commas at that depth part the fields. Inside a field one blank parts two words,
    and a comma is followed by one.
    """
    tokens = F.regexp_extract_all(without_comments(F.coalesce(F.col(sql), F.lit(""))), F.lit(f"({_TOKEN})"), F.lit(1))
    opening = F.transform("_upper", lambda t, i: (t == "GROUP") & (F.get("_upper", i + 1) == "BY"))
    begin = F.array_position("_opening", F.lit(True))
    state = F.struct(
        F.lit(0).alias("depth"),
        F.lit(False).alias("over"),
        F.lit("").alias("field"),
        F.array().cast("array<string>").alias("fields"),
    )

    def step(s: Column, token: Column) -> Column:
        top = s["depth"] == 0
        ends = top & (token.isin(")", ";") | F.upper(token).isin(*_CLAUSE_END))
        over = s["over"] | ends
        parts = top & (token == ",")
        depth = F.when(token == "(", s["depth"] + 1).when(token == ")", s["depth"] - 1).otherwise(s["depth"])
        blank = s["field"].rlike(r"[\w$.'\"`]$") & token.rlike(r"^[\w$.'\"`]") | s["field"].rlike(",$")
        longer = F.concat(s["field"], F.when(blank, F.lit(" ")).otherwise(F.lit("")), token)
        return F.struct(
            F.when(over, s["depth"]).otherwise(depth).alias("depth"),
            over.alias("over"),
            F.when(over, s["field"]).when(parts, F.lit("")).otherwise(longer).alias("field"),
            F.when(~over & parts, F.concat(s["fields"], F.array(s["field"]))).otherwise(s["fields"]).alias("fields"),
        )

    rest = F.greatest(F.size("_tokens") - F.col("_begin") - 1, F.lit(0)).cast("int")
    clause = F.when(F.col("_begin") > 0, F.slice("_tokens", (F.col("_begin") + 2).cast("int"), rest))
    read = F.aggregate(
        F.coalesce(clause, F.array().cast("array<string>")), state, step, lambda s: F.concat(s["fields"], F.array(s["field"]))
    )
    named = (
        log.withColumn("_tokens", tokens)
        .withColumn("_upper", F.transform("_tokens", F.upper))
        .withColumn("_opening", opening)
        .withColumn("_begin", F.coalesce(begin, F.lit(0)))
        .withColumn("_fields", F.filter(read, lambda f: (f != "") & ~f.rlike(r"^\d+$")))
    )
    return named.select(*log.columns, F.size("_fields").alias("n_fields"), F.array_join("_fields", "|").alias("group_fields"))


_STAGE = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
    ]
)
TRACE_SCHEMA = T.StructType(
    [
        T.StructField("trace", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("row_count_result", T.LongType()),
        T.StructField("sql_execution_status", T.StringType()),
        T.StructField("failure_type", T.StringType()),
        T.StructField("stages", T.ArrayType(_STAGE)),
    ]
)


def parse_traces(log: DataFrame, payload: str = "payload") -> DataFrame:
    """Trace records; a line that is no JSON gives NULL fields."""
    return log.select(F.from_json(payload, TRACE_SCHEMA).alias("t")).select("t.*")


def trace_stages(log: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per executed stage; durations to two places, exact."""
    stages = parse_traces(log, payload).select(F.explode("stages").alias("s"))
    return stages.select("s.stage", "s.status", F.col("s.duration_ms").cast("decimal(14,2)").alias("duration_ms"))


def _stage_totals(stages: DataFrame, *more: Column) -> DataFrame:
    return stages.groupBy("stage").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count("duration_ms").alias("timed"),
        F.sum("duration_ms").alias("total"),
        F.max("duration_ms").alias("slowest"),
        *more,
    )


def _stage_report(totals: DataFrame, quantiles: Sequence[str]) -> DataFrame:
    average = F.when(F.col("timed") > 0, as_double(F.col("total")) / as_double(F.col("timed")))
    return totals.select(
        "stage",
        "runs",
        "failed",
        average.alias("avg_ms"),
        *[as_double(F.col(q)).alias(q) for q in quantiles],
        as_double(F.col("slowest")).alias("max_ms"),
    ).orderBy("stage")


def duration_band() -> Column:
    """A band that grows with the duration, sixteen to a doubling: at most some 750 per stage."""
    hundredths = F.greatest(F.col("duration_ms"), F.lit(0)).cast("double") * 100.0 + 1.0
    return F.floor(F.log2(hundredths) * 16.0).cast("int")


def duration_percentiles(stages: DataFrame, percents: Sequence[int]) -> DataFrame:
    """Exact percentiles ``(stage, percent, duration_ms)``: the smallest value reaching the rank.

    Runs are counted per distinct duration first. Running totals over the few bands of a stage
    tell which band holds a rank; only the durations of that band are put in order.
    """
    counted = stages.where(F.col("duration_ms").isNotNull()).groupBy("stage", "duration_ms").agg(F.count("*").alias("n"))
    counted = counted.withColumn("band", duration_band())
    by_stage = Window.partitionBy("stage")
    so_far = by_stage.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    bands = counted.groupBy("stage", "band").agg(F.sum("n").alias("inside"))
    bands = bands.withColumn("upto", F.sum("inside").over(so_far)).withColumn("runs", F.sum("inside").over(by_stage))
    bands = bands.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    rank = F.col("runs") * F.col("percent")
    before = F.col("upto") - F.col("inside")
    holding = bands.where((F.col("upto") * 100 >= rank) & (before * 100 < rank))
    inside = Window.partitionBy("stage", "percent").orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(holding.select("stage", "band", "percent", before.alias("before"), rank.alias("rank")), ["stage", "band"])
    reached = ranked.withColumn("upto", F.sum("n").over(inside) + F.col("before")).where(F.col("upto") * 100 >= F.col("rank"))
    return reached.groupBy("stage", "percent").agg(F.min("duration_ms").alias("duration_ms"))


def trace_stage_stats(log: DataFrame, percents: Sequence[int] = (50, 95), payload: str = "payload") -> DataFrame:
    """Runs, failures and exact duration percentiles per stage; the log is parsed once."""
    stages = cut_lineage(trace_stages(log, payload))
    names = {p: f"p{p}_ms" for p in percents}
    values = duration_percentiles(stages, percents).groupBy("stage").agg(
        *[F.max(F.when(F.col("percent") == p, F.col("duration_ms"))).alias(q) for p, q in names.items()]
    )
    return _stage_report(_stage_totals(stages).join(values, "stage", "left"), list(names.values()))


def trace_stage_stats_approx(
    log: DataFrame, percents: Sequence[int] = (50, 95), accuracy: int = 10_000, payload: str = "payload"
) -> DataFrame:
    """The same in one aggregation, percentiles from a sketch of bounded size."""
    names = [f"p{p}_ms" for p in percents]
    sketches = [F.percentile_approx("duration_ms", p / 100, accuracy).alias(q) for p, q in zip(percents, names)]
    return _stage_report(_stage_totals(trace_stages(log, payload), *sketches), names)


def trace_failures(log: DataFrame, payload: str = "payload") -> DataFrame:
    """Failed queries per type and the sessions they hit; no rows without an error counts as a type."""
    traces = parse_traces(log, payload)
    empty = (F.col("row_count_result") == 0) & (F.col("sql_execution_status") == "success")
    kind = F.coalesce(F.col("failure_type"), F.when(empty, "EMPTY_RESULT_SET"))
    failed = traces.select(kind.alias("failure_type"), "session_id").where(F.col("failure_type").isNotNull())
    per_session = failed.groupBy("failure_type", "session_id").agg(F.count("*").alias("n"))
    return per_session.groupBy("failure_type").agg(
        F.sum("n").alias("queries"), F.count("session_id").alias("sessions")
    ).orderBy("failure_type")
