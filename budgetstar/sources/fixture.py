"""Wide budget tables, question tables and logs derived from the provided star-schema tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetstar.model import DIMENSIONS, PHASES, cell_columns, text_columns

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
YEARS = tuple(range(1995, 2002))
CUTOFF = 2000  # 2001 plays the blocked year
REPORT_YEAR = 1998


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _amounts() -> dict[str, Column]:
    """The amounts of a line item that phases are made of."""
    ext = F.col("l_extendedprice").cast("decimal(12,2)")
    net = ext * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(4,2)"))
    dec = lambda text: F.lit(text).cast("decimal(3,2)")
    return {"open": ext * dec("0.90"), "ext": ext, "net": net, "due": net * dec("0.95"), "low": net * dec("0.50")}


def _phase_amounts(size: str) -> dict[str, Column]:
    """Phases from the ``full`` or ``half`` amounts."""
    amount = {name: F.col(f"{size}_{name}") for name in _amounts()}
    finished = F.col("l_linestatus") == "F"
    return {
        "pia": F.when(F.col("l_linenumber") % 3 == 0, F.lit("0.00").cast("decimal(18,2)")).otherwise(amount["open"]),
        "pim": amount["ext"],
        "certificado": F.when(F.col("l_returnflag") != "N", amount["net"]),
        "comprometido_anual": amount["net"],
        "comprometido": amount["due"],
        "devengado": F.when(finished, amount["net"]).otherwise(amount["low"]),
        "girado": F.when(finished, amount["net"]),
    }


SLICE_BYTES, SLICES = 128 << 20, 4


def budget_slices(spark: SparkSession, sf_dir: str, years: Sequence[int] = YEARS) -> list[DataFrame]:
    """The records of ``wide_budget`` in slices by the hash of the order key, each record in one of them.

    Written one after the other, they take the local disk for the shuffles of one slice only. Line
    items and orders are read once per slice, so large tables have SLICES of them and no more.
    """
    size = int(str(table(spark, sf_dir, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    count = min(SLICES, max(1, -(-size // SLICE_BYTES)))
    return [wide_budget(spark, sf_dir, years, (number, count)) for number in range(count)]


def wide_budget(
    spark: SparkSession, sf_dir: str, years: Sequence[int] = YEARS, part: tuple[int, int] = (0, 1)
) -> DataFrame:
    """One budget record per line item: descriptive columns plus one amount per phase and year.

    Join strategies are left to the optimizer: region, nation and supplier are small at any scale
    factor it has seen, part and customer are broadcast only while their measured size allows it.
    Line items are dealt by the key of their first join, at any size. Orders meet their customers
    before the line items do, and names of nations and regions come last, so what is dealt again by
    the next key is never wider than it has to be. ``part`` is the number of a slice and their count.
    """

    def sliced(name: str, key: str) -> DataFrame:
        number, count = part
        rows = table(spark, sf_dir, name)
        return rows if count == 1 else rows.where(F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(count)) == number)

    line = sliced("lineitem", "l_orderkey").withColumn("y0", F.year("l_shipdate")).repartition("l_orderkey")
    orders, customer = sliced("orders", "o_orderkey"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")

    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nation"),
        F.col("n_name").alias("provincia"),
        F.col("r_regionkey").alias("departamento"),
        F.col("r_name").alias("departamento_nombre"),
    )
    sectors = nation.select(F.col("n_nationkey").alias("s_nation"), F.col("n_name").alias("s_nation_name"))
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))

    joined = (
        line.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("c_nationkey") == F.col("c_nation"))
        .join(sectors, F.col("s_nationkey") == F.col("s_nation"))
    )

    def sector(value: str) -> Column:
        tail = F.col("s_suppkey") % 10
        return F.when(tail == 0, F.lit(None)).when(tail == 1, F.lit(" ")).otherwise(F.col(value).cast("string"))

    known = {
        "departamento_ejecutora": F.col("departamento"),
        "departamento_ejecutora_nombre": F.col("departamento_nombre"),
        "provincia_ejecutora": F.col("c_nation"),
        "provincia_ejecutora_nombre": F.col("provincia"),
        "distrito_ejecutora": F.col("c_mktsegment"),
        "distrito_ejecutora_nombre": F.col("c_mktsegment"),
        "nivel_gobierno": F.col("o_orderstatus"),
        "nivel_gobierno_nombre": F.col("o_orderstatus"),
        "sector": sector("s_nation"),
        "sector_nombre": sector("s_nation_name"),
        "pliego": F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 20),
        "sec_ejec": F.col("s_suppkey"),
        "ejecutora_nombre": F.col("s_name"),
        "programa_ppto": F.col("p_brand"),
        "programa_ppto_nombre": F.col("p_brand"),
        "producto_proyecto": F.col("p_partkey"),
        "producto_proyecto_nombre": F.col("p_name"),
        "funcion": F.col("p_type"),
        "funcion_nombre": F.col("p_type"),
        "meta": F.col("p_size"),
        "tipo_transaccion": F.col("l_linestatus"),
        "generica": F.col("l_returnflag"),
        "generica_nombre": F.col("l_returnflag"),
        "subgenerica": F.col("l_linenumber"),
        "fuente_financiamiento": F.col("o_orderpriority"),
        "fuente_financiamiento_nombre": F.col("o_orderpriority"),
        "rubro": F.substring("o_orderpriority", 1, 1),
    }
    descriptive = [
        known.get(c, F.lit(None)).cast("string").alias(c) for d in DIMENSIONS for c in d.columns
    ]
    # Full and half amounts are worked out once per record; the cells only pick one.
    odd = F.col("l_linenumber") % 2 == 1
    parts = {"odd": odd}
    for name, amount in _amounts().items():
        base = amount.cast("decimal(18,6)")
        parts[f"full_{name}"] = base.cast("decimal(18,2)")
        parts[f"half_{name}"] = F.when(odd, (base * F.lit("0.50").cast("decimal(3,2)")).cast("decimal(18,2)"))
    joined = joined.withColumns(parts)
    full, half = _phase_amounts("full"), _phase_amounts("half")

    def cell(phase: str, year: int) -> Column:
        return (
            F.when(F.col("y0") == year, full[phase])
            .when((F.col("y0") + 1 == year) & F.col("odd"), half[phase])
            .alias(f"{phase}_{year}")
        )

    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    cells = [cell(phase, year) for phase in PHASES for year in years]
    return joined.select(key.alias("key_value"), *descriptive, *cells)


def _noisy_header(column: str) -> str:
    """The header as a careless source would write it; normalising gives the column back."""
    words = column.replace("_", " ").title() if column != "key_value" else "KEY_VALUE"
    return f" {words} ".replace("Programa", "Prográma").replace("Funcion", "Función")


def bronze_headers(columns: Sequence[str]) -> dict[str, str]:
    return {c: _noisy_header(c) for c in columns}


def bronze_text(spark: SparkSession, sf_dir: str, years: Sequence[int] = YEARS) -> DataFrame:
    """The wide table as an all-text source file: noisy headers, padded text, unreadable amounts."""
    wide = wide_budget(spark, sf_dir, years)
    line_no = F.element_at(F.split("key_value", "-"), 2).cast("int")
    noisy = bronze_headers(wide.columns)

    def padded(c: str) -> Column:
        value = F.col(c)
        return F.when(line_no % 4 == 0, F.concat(F.lit("  "), F.lower(value), F.lit(" "))).otherwise(value)

    def amount(c: str) -> Column:
        return F.when(line_no % 5 == 0, F.lit("n/d")).otherwise(F.col(c).cast("string"))

    text = [padded(c).alias(noisy[c]) for c in text_columns(wide.columns)]
    cells = [amount(c).alias(noisy[c]) for c in cell_columns(wide.columns)]
    return wide.select(*text, *cells)


# How columns of an order are asked about (English, Spanish). Priorities and states name
# a family each, or none.
ASKED_BY_PRIORITY = {
    "1-URGENT": ("department", "departamento"),
    "2-HIGH": ("sectors", "sectores"),
    "3-MEDIUM": ("program", "programa"),
    "4-NOT SPECIFIED": ("financing source", "fuente de financiamiento"),
}
ASKED_BY_STATUS = {"O": ("projects", "proyectos"), "P": ("economic category", "categoria de gasto")}


def question_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per order: families, language and the time axis follow from its columns.

    The customer, the price and the date stand in the text as well, so hardly two are alike.
    """
    spanish = F.col("o_custkey") % 2 == 1

    def asked(column: str, words: dict[str, tuple[str, str]]) -> Column:
        phrase = F.lit("")
        for value, (english, local) in words.items():
            by = F.when(spanish, F.lit(f" por {local}")).otherwise(F.lit(f" by {english}"))
            phrase = F.when(F.col(column) == value, by).otherwise(phrase)
        return phrase

    time = F.when(F.col("o_orderkey") % 3 == 0, F.when(spanish, F.lit(" por año")).otherwise(F.lit(" per year"))).otherwise(F.lit(""))
    text = F.concat(
        F.when(spanish, F.lit("¿Cuanto fue el PIM")).otherwise(F.lit("Show PIM")),
        asked("o_orderpriority", ASKED_BY_PRIORITY),
        asked("o_orderstatus", ASKED_BY_STATUS),
        time,
        F.lit(" ("),
        F.col("o_custkey").cast("string"),
        F.lit("; "),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(")?"),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), text.alias("question"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per document: its text is a quoted literal or a comment, its labels are names.

    The form follows from the document number: grouped reads with a clause behind, reads through a
    CTE, writes, two statements.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    note = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    remark = F.concat(F.lit("/* "), F.replace(text, F.lit("*/"), F.lit("* /")), F.lit(" */"))
    lang, source = F.col("lang"), F.col("source")
    forms = [
        ("SELECT ", lang, ", sum(monto), ", note, " AS note FROM ", source, " GROUP BY ", lang, ", 2 order by 1 ", remark),
        (remark, " select `", source, "`, date_trunc('y', d) from t group by `", source, "`, date_trunc('y', d) having count(*) > 1;"),
        ("DELETE FROM ", source, " WHERE note = ", note),
        ("SELECT ", note, " AS a; DROP TABLE ", source),
        ("WITH x AS (SELECT ", source, ", sum(b) s FROM t WHERE note = ", note, " GROUP BY ", source, ") SELECT * FROM x WHERE s > 1"),
        ("WITH x AS (SELECT 1) UPDATE t SET a = ", note, " ", remark),
    ]
    written = [F.concat(*[F.lit(p) if isinstance(p, str) else p for p in form]) for form in forms]
    sql = F.lit(None).cast("string")
    for number, form in enumerate(written):
        sql = F.when(F.col("doc_id") % len(forms) == number, form).otherwise(sql)
    return docs.select(F.col("doc_id").alias("query_id"), sql.alias("sql"))


# How event types stand in for execution stages.
STAGE_OF_EVENT = {
    "view": "SEMANTIC_VALIDATION",
    "click": "SQL_EXECUTION",
    "purchase": "RESULT_TRANSFORMATION",
    "signup": "SQL_GENERATION",
    "error": "SQL_EXECUTION",
}
FAILURES_OF_EVENT = ("SQL_SYNTAX_ERROR", "MISSING_GROUP_BY", "DATA_JOIN_MISMATCH")


def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per event, shaped like the execution log of a query service."""
    events = table(spark, sf_dir, "events")
    stage = F.lit("USER_INPUT")
    for event, name in STAGE_OF_EVENT.items():
        stage = F.when(F.col("event_type") == event, name).otherwise(stage)
    failed = F.col("event_type") == "error"
    failure = F.when(
        failed,
        F.element_at(
            F.array(*[F.lit(f) for f in FAILURES_OF_EVENT]),
            (F.col("event_id") % len(FAILURES_OF_EVENT) + 1).cast("int"),
        ),
    )
    first = F.struct(
        F.lit("INTENT_PARSING").alias("stage"),
        F.lit("succeeded").alias("status"),
        F.lit(1.0).alias("duration_ms"),
    )
    second = F.struct(
        stage.alias("stage"),
        F.when(failed, "failed").otherwise("succeeded").alias("status"),
        F.col("value").alias("duration_ms"),
    )
    payload = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("trace"),
            F.lit("query_complete").alias("event"),
            F.col("user_id").cast("string").alias("session_id"),
            (F.col("event_id") % 4).alias("row_count_result"),
            F.when(failed, "failed").otherwise("success").alias("sql_execution_status"),
            failure.alias("failure_type"),
            F.array(first, second).alias("stages"),
        )
    )
    return events.select(F.col("event_id").cast("string").alias("trace_id"), payload.alias("payload"))
