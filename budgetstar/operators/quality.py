"""Data-quality operators: reconciliation gates, volumes, key audits, storage, drift, sample gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetstar.functions.money import as_double, rounded_pct
from budgetstar.model import (
    EXECUTED,
    FACT_COLUMNS,
    PLANNED,
    Star,
    cell_columns,
    split_cell,
)
from budgetstar.operators.aggregate import aggregate, phase_total
from budgetstar.operators.clean import present
from budgetstar.sources.shared import cut_lineage

TOLERANCE = "0.01"  # fixed value: largest accepted difference of two totals


def _zero() -> Column:
    return F.lit(0).cast("decimal(28,2)")


def _tolerance() -> Column:
    return F.lit(TOLERANCE).cast("decimal(4,2)")


def layer_total(table: DataFrame) -> DataFrame:
    """One-row exact total of a long table or of all phase_year columns of a wide one."""
    cells = ["monto"] if "monto" in table.columns else cell_columns(table.columns)
    sums = table.agg(*[F.coalesce(F.sum(F.col(c).cast("decimal(18,2)")), _zero()).alias(c) for c in cells])
    return sums.select(reduce(lambda a, b: a + b, [F.col(c) for c in cells]).cast("decimal(30,2)").alias("total"))


def reconcile_total(silver: DataFrame, fact: DataFrame) -> DataFrame:
    """Totals of both layers, their difference and whether it is within tolerance.

    A wide silver table is summed column by column, without the unpivot it is meant to check.
    """
    both = layer_total(silver).select(
        F.col("total").alias("silver_total"), layer_total(fact).scalar().alias("gold_total")
    )
    gap = F.abs(F.col("silver_total") - F.col("gold_total"))
    return both.select(
        as_double(F.col("silver_total")).alias("silver_total"),
        as_double(F.col("gold_total")).alias("gold_total"),
        as_double(gap).alias("discrepancy"),
        (gap <= _tolerance()).alias("passed"),
    )


def require_reconciled(silver: DataFrame, fact: DataFrame) -> None:
    """The gate between the star and the reports."""
    row = reconcile_total(silver, fact).first()
    if not row.passed:
        raise ValueError(f"Data quality audit failed. Financial mismatch detected: S/. {row.discrepancy:,.2f}")


def wide_by_year_phase(wide: DataFrame) -> DataFrame:
    """Sums of a wide table by year and phase from one row of column sums."""
    cells = cell_columns(wide.columns)
    sums = wide.agg(*[F.sum(c).alias(c) for c in cells])
    pairs = [e for c in cells for e in (F.lit(split_cell(c)[1]), F.lit(split_cell(c)[0]), F.col(c))]
    stacked = sums.select(F.stack(F.lit(len(cells)), *pairs).alias("anio", "fase", "monto"))
    return stacked.where(F.col("monto").isNotNull() & (F.col("monto") != 0))


def by_year_phase(long: DataFrame) -> DataFrame:
    return long.where(F.col("monto").isNotNull()).groupBy("anio", "fase").agg(F.sum("monto").alias("monto"))


def reconcile_by_year_phase(silver: DataFrame, fact: DataFrame) -> DataFrame:
    left = by_year_phase(silver) if "monto" in silver.columns else wide_by_year_phase(silver)
    joined = left.withColumnRenamed("monto", "s").join(
        by_year_phase(fact).withColumnRenamed("monto", "g"), ["anio", "fase"], "full"
    )
    s, g = (F.coalesce(F.col(c), _zero()) for c in "sg")
    return joined.select(
        "anio",
        "fase",
        as_double(s).alias("monto_silver"),
        as_double(g).alias("monto_gold"),
        as_double(s - g).alias("diferencia"),
        (F.abs(s - g) > _tolerance()).alias("is_break"),
    ).orderBy("anio", "fase")


def volumetrics(silver: DataFrame, fact: DataFrame) -> DataFrame:
    """Rows of the long layer before and after dropping empty amounts, and rows of the fact."""
    if "monto" in silver.columns:
        counts = silver.agg(F.count("*").alias("total"), F.count_if(present()).alias("clean"))
    else:
        cells = cell_columns(silver.columns)
        per_cell = silver.agg(F.count("*").alias("n"), *[F.count_if(present(c)).alias(c) for c in cells])
        counts = per_cell.select(
            (F.col("n") * len(cells)).alias("total"), reduce(lambda a, b: a + b, [F.col(c) for c in cells]).alias("clean")
        )
    rows = counts.withColumn("fact", fact.agg(F.count("*")).scalar())
    return rows.select(
        F.col("total").alias("silver_rows"),
        F.col("clean").alias("clean_rows"),
        (F.col("total") - F.col("clean")).alias("dropped_rows"),
        F.col("fact").alias("fact_rows"),
        (F.col("clean") - F.col("fact")).alias("unexplained_gap"),
    )


def key_uniqueness(wide: DataFrame, key: str = "key_value") -> DataFrame:
    counts = wide.agg(F.count("*").alias("total_rows"), F.count_distinct(key).alias("unique_keys"))
    repeated = F.col("total_rows") - F.col("unique_keys")
    return counts.select("*", repeated.alias("duplicate_rows"), (repeated == 0).alias("is_unique"))


def duplicate_keys(wide: DataFrame, key: str = "key_value") -> DataFrame:
    return wide.groupBy(key).agg(F.count("*").alias("repetitions")).where(F.col("repetitions") > 1)


def _repeated_records(wide: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Records whose key occurs more than once, with the number of repetitions.

    Counting moves keys only, and the few repeated keys are written once. Their measured size then
    decides how they meet the records; a key with a third of all rows is split by the skew handling
    of the join, and what follows combines its records inside each task.
    """
    repeated = cut_lineage(duplicate_keys(wide, key))
    return wide.select(key, *columns).join(repeated, key)


def duplicate_key_diff(wide: DataFrame, key: str = "key_value") -> DataFrame:
    """Per repeated key, the columns whose values differ between its rows (NULL counts as a value).

    A column of a key holds one value if the AND and the OR of its 64-bit hashes are equal, so
    records of any number are combined to two fixed-width numbers per column where they are read.
    """
    columns = sorted(c for c in wide.columns if c != key)
    records = _repeated_records(wide, key, columns)
    hashed = records.select(key, "repetitions", *[F.xxhash64(F.col(c).isNull(), c).alias(f"h{i}") for i, c in enumerate(columns)])
    ends = [e for i in range(len(columns)) for e in (F.bit_and(f"h{i}").alias(f"a{i}"), F.bit_or(f"h{i}").alias(f"o{i}"))]
    groups = hashed.groupBy(key).agg(F.max("repetitions").alias("repetitions"), *ends)
    names = F.array_compact(F.array(*[F.when(F.col(f"a{i}") != F.col(f"o{i}"), F.lit(c)) for i, c in enumerate(columns)]))
    return groups.select(key, "repetitions", names.alias("names")).select(
        key, "repetitions", F.size("names").alias("n_columns"), F.array_join("names", ",").alias("differing_columns")
    )


def duplicate_key_amounts(wide: DataFrame, key: str = "key_value") -> DataFrame:
    """Per repeated key, the amount columns with a positive sum."""
    cells = cell_columns(wide.columns)
    totals = _repeated_records(wide, key, cells).groupBy(key).agg(*[F.sum(c).alias(c) for c in cells])
    pairs = [e for c in cells for e in (F.lit(c), F.col(c))]
    long = totals.select(key, F.stack(F.lit(len(cells)), *pairs).alias("column_name", "total"))
    return long.where(F.col("total") > 0).select(key, "column_name", as_double(F.col("total")).alias("total"))


PREVIEW_ROWS = 10


def table_audit(star: Star, rows: int = PREVIEW_ROWS) -> DataFrame:
    """Row count, columns, key cardinality and first rows of every gold table as one long table.

    One scan of a table gives its rows and the distinct values of all its keys: the keys are
    stacked as (name, value) and counted in two levels, so a frequent key is one row per task. The
    preview holds the rows that come first by a hash of the whole row, as JSON.
    """
    spark = star.fact.sparkSession
    frames = []
    for name, table in star.tables().items():
        schema = [(name, "column", f.name, f.dataType.simpleString()) for f in table.schema.fields]
        frames.append(spark.createDataFrame(schema, "table_name string, item string, name string, value string"))
        frames.append(_cardinality(name, table))
        frames.append(preview(table, rows).select(F.lit(name).alias("table_name"), F.lit("preview").alias("item"), F.lit("*").alias("name"), "value"))
    return reduce(DataFrame.unionByName, frames)


def _cardinality(name: str, table: DataFrame) -> DataFrame:
    keys = [c for c in table.columns if c.startswith("sk_")]
    cells = [e for c in keys for e in (F.lit(c), F.col(c).cast("bigint"))]
    stacked = table.select(F.stack(F.lit(len(keys)), *cells).alias("name", "key"))
    counted = stacked.groupBy("name", "key").agg(F.count("*").alias("n"))
    per_key = counted.groupBy("name").agg(F.count("key").alias("values"), F.sum("n").alias("rows"))
    found = per_key.select(
        F.stack(
            F.lit(2),
            F.lit("distinct"), F.col("name"), F.col("values"),
            F.when(F.col("name") == keys[0], F.lit("rows")), F.lit("*"), F.col("rows"),
        ).alias("item", "name", "value")
    )
    # An empty table has no stacked row; its zero counts come from here.
    none = [("distinct", c) for c in keys] + [("rows", "*")]
    every = table.sparkSession.createDataFrame(none, "item string, name string")
    counts = found.where(F.col("item").isNotNull())
    return every.join(counts, ["item", "name"], "left").select(
        F.lit(name).alias("table_name"), "item", "name", F.coalesce("value", F.lit(0)).cast("string").alias("value")
    )


def preview(table: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The rows with the smallest md5 of all their values, joined as text: the same on every run."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in table.columns])
    return table.select(text.alias("value")).orderBy(F.md5("value"), "value").limit(rows)


def layer_storage(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Files, bytes and rows per stored layer, from file metadata and Parquet footers."""

    def usage(name: str, table: DataFrame) -> DataFrame:
        files = table.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(
            F.count("*").alias("n")
        )
        return files.agg(
            F.lit(name).alias("layer"),
            F.count("*").alias("files"),
            F.sum("size").alias("bytes"),
            F.sum("n").alias("rows"),
        )

    return reduce(DataFrame.unionByName, [usage(n, t) for n, t in tables.items()])


def snapshot(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: schema text, rows, exact total and an order-free hash of all rows."""

    def line(name: str, table: DataFrame) -> DataFrame:
        schema = ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in table.schema.fields))
        total = F.sum("monto") if "monto" in table.columns else F.lit(None)
        hashed = F.xxhash64(*[F.col(c) for c in sorted(table.columns)]).cast("decimal(20,0)")
        return table.agg(
            F.lit(name).alias("table_name"),
            F.lit(schema).alias("schema"),
            F.count("*").alias("rows"),
            total.cast("decimal(30,2)").alias("total"),
            F.sum(hashed).alias("row_hash"),
        )

    return reduce(DataFrame.unionByName, [line(n, t) for n, t in tables.items()])


def run_drift(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two snapshots side by side; schema, rows and hash have to be equal, totals within tolerance."""
    a = first.select("table_name", *[F.col(c).alias(f"{c}_a") for c in first.columns if c != "table_name"])
    b = second.select("table_name", *[F.col(c).alias(f"{c}_b") for c in second.columns if c != "table_name"])
    total_gap = F.abs(F.coalesce(F.col("total_a"), _zero()) - F.coalesce(F.col("total_b"), _zero()))
    checks = {
        "same_schema": F.col("schema_a").eqNullSafe(F.col("schema_b")),
        "same_rows": F.col("rows_a").eqNullSafe(F.col("rows_b")),
        "same_total": total_gap <= _tolerance(),
        "same_content": F.col("row_hash_a").eqNullSafe(F.col("row_hash_b")),
    }
    passed = reduce(lambda x, y: x & y, checks.values())
    return a.join(b, "table_name", "full").select(
        "table_name",
        F.col("rows_a"),
        F.col("rows_b"),
        as_double(F.col("total_a")).alias("total_a"),
        as_double(F.col("total_b")).alias("total_b"),
        *[c.alias(n) for n, c in checks.items()],
        passed.alias("passed"),
    )


def drift_rows(first: Mapping[str, DataFrame], second: Mapping[str, DataFrame], ranges: int = 1 << 14) -> DataFrame:
    """Rows that only one run has: ``table_name``, ``side``, ``row`` (columns in order, NULL as ~) and ``n``.

    Rows fall into ranges of their hash. Per range, count and two order-free sums of hashes are
    compared, which sends one row per range and task; rows of ranges that differ are then set side
    by side, all others are neither moved nor read again in full. A table of one run only counts as empty
    in the other.
    """

    def keyed(table: DataFrame, columns: Sequence[str]) -> DataFrame:
        hashed = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
        other = F.hash(*[F.col(f"`{c}`") for c in columns])
        return table.select(*columns, F.pmod(hashed, F.lit(ranges)).alias("_range"), hashed.alias("_a"), other.alias("_b"))

    def sums(table: DataFrame, side: str) -> DataFrame:
        whole = [F.sum(F.col(c).cast("decimal(20,0)")).alias(f"{c}_{side}") for c in ("_a", "_b")]
        return table.groupBy("_range").agg(F.count("*").alias(f"n_{side}"), *whole)

    def text(columns: Sequence[str]) -> Column:
        return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in columns]).alias("row")

    found = []
    for name in sorted({*first, *second}):
        a, b = first.get(name), second.get(name)
        a, b = (b.limit(0) if a is None else a), (a.limit(0) if b is None else b)
        if a.columns != b.columns:
            raise ValueError(f"{name} has other columns in the second run: {', '.join(b.columns)}")
        x, y = keyed(a, a.columns), keyed(b, a.columns)
        met = sums(x, "x").join(sums(y, "y"), "_range", "full")
        same = reduce(lambda p, q: p & q, [F.col(f"{c}_x").eqNullSafe(F.col(f"{c}_y")) for c in ("n", "_a", "_b")])
        open_ = met.where(~same).select("_range")
        counted = reduce(
            DataFrame.unionByName,
            [t.join(open_, "_range", "left_semi").select(text(a.columns), F.lit(sign).alias("sign")) for t, sign in ((x, 1), (y, -1))],
        )
        apart = counted.groupBy("row").agg(F.sum("sign").alias("n")).where("n <> 0")
        side = F.when(F.col("n") > 0, F.lit("first")).otherwise(F.lit("second"))
        found.append(apart.select(F.lit(name).alias("table_name"), side.alias("side"), "row", F.abs("n").alias("n")))
    return reduce(DataFrame.unionByName, found)


def require_no_drift(drift: DataFrame) -> None:
    broken = [r.table_name for r in drift.where(~F.col("passed")).select("table_name").collect()]
    if broken:
        raise RuntimeError(f"Pipeline is not deterministic: {', '.join(broken)}")


def fact_year_range(fact: DataFrame) -> DataFrame:
    return fact.agg(F.min("anio").alias("first_year"), F.max("anio").alias("last_year"))


def execution_rates(fact: DataFrame) -> DataFrame:
    """Planned, executed and rate in percent (two places) per year and for all years.

    The overall row is rolled up from the yearly sums, so the fact is read once.
    """

    def total(phase: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("fase") == phase, F.col("monto"))), _zero())

    yearly = fact.groupBy("anio").agg(total(PLANNED).alias("p"), total(EXECUTED).alias("d"))
    rolled = yearly.rollup("anio").agg(
        F.grouping("anio").alias("is_total"), F.sum("p").alias("pim"), F.sum("d").alias("devengado")
    )
    scope = F.when(F.col("is_total") == 1, F.lit("global")).otherwise(F.col("anio").cast("string"))
    rate = F.when(F.col("pim") != 0, rounded_pct(F.col("devengado"), F.col("pim")))
    return rolled.select(
        scope.alias("scope"),
        as_double(F.col("pim")).alias("pim"),
        as_double(F.col("devengado")).alias("devengado"),
        as_double(rate).alias("execution_rate_pct"),
    ).orderBy("scope")


def region_pim_share(star: Star) -> DataFrame:
    """Planned amount and share per department, facts without a department left out."""
    groups = aggregate(
        star,
        {"pim": phase_total(PLANNED)},
        {"department": "departamento_ejecutora_nombre"},
        fact_where=[F.col("fase") == PLANNED],
        where=[F.col("departamento_ejecutora_nombre").isNotNull()],
        how="inner",
        guard=False,
    )
    return _shares(groups)


def _shares(groups: DataFrame) -> DataFrame:
    shares = groups.withColumn("national", groups.agg(F.sum("pim")).scalar()).where(F.col("national") != 0)
    return shares.select(
        "department",
        as_double(F.col("pim")).alias("pim"),
        as_double(rounded_pct(F.col("pim"), F.col("national"))).alias("share_pct"),
    ).orderBy(F.col("pim").desc(), "department")


def sample_summary(star: Star) -> DataFrame:
    """One pass over the facts: rows, NULLs per column and phase sums by year and department key.

    The result has one row per year and geography key; gates, rates, shares and counts of a sample
    are all worked out from it. It is written once, because each of them reads it.
    """
    summed = star.fact.groupBy("anio", "sk_geografia_id").agg(
        F.count("*").alias("rows"),
        *[F.coalesce(F.sum(F.when(F.col("fase") == p, F.col("monto"))), _zero()).alias(p) for p in (PLANNED, EXECUTED)],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in FACT_COLUMNS],
    )
    return cut_lineage(summed)


def _summary_rates(summary: DataFrame) -> DataFrame:
    stacked = summary.select(
        "anio",
        F.stack(F.lit(2), F.lit(PLANNED), F.col(PLANNED), F.lit(EXECUTED), F.col(EXECUTED)).alias("fase", "monto"),
    )
    return execution_rates(stacked)


def _summary_shares(summary: DataFrame, star: Star) -> DataFrame:
    members = star.dim("geografia").select("sk_geografia_id", F.col("departamento_ejecutora_nombre").alias("department"))
    planned = summary.groupBy("sk_geografia_id").agg(F.sum(PLANNED).alias("pim"))
    named = planned.join(members, "sk_geografia_id").where(F.col("department").isNotNull() & (F.col("pim") != 0))
    return _shares(named.groupBy("department").agg(F.sum("pim").alias("pim")))


def sample_gates(
    star: Star,
    target_rows: int,
    row_tolerance: float = 0.001,
    region_threshold: float = 50.0,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Acceptance gates of a sample as ``(gate, scope, value, passed)``.

    Rates must lie in [0, 100] for every year and overall, the row count must meet the target, no
    fact column may hold a NULL. Concentration is reported and always passes. The facts are read
    once, or not at all with a ``summary`` of them.
    """
    summary = sample_summary(star) if summary is None else summary
    rates = _summary_rates(summary).select(
        F.lit("execution_rate").alias("gate"),
        "scope",
        F.col("execution_rate_pct").alias("value"),
        F.coalesce(F.col("execution_rate_pct").between(0.0, 100.0), F.lit(False)).alias("passed"),
    )
    counts = summary.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("double").alias("rows"),
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).cast("double").alias(c) for c in FACT_COLUMNS],
    )
    slack = float(max(1, int(target_rows * row_tolerance)))
    lines = [("row_target", "rows", F.abs(F.col("rows") - target_rows) <= slack)]
    lines += [("null_values", c, F.col(c) == 0) for c in FACT_COLUMNS]
    cells = [e for gate, c, ok in lines for e in (F.lit(gate), F.lit(c), F.col(c), ok)]
    checks = counts.select(F.stack(F.lit(len(lines)), *cells).alias("gate", "scope", "value", "passed"))
    largest = _summary_shares(summary, star).limit(1)
    concentration = largest.where(F.col("share_pct") > region_threshold).select(
        F.lit("concentration_note").alias("gate"),
        F.col("department").alias("scope"),
        F.col("share_pct").alias("value"),
        F.lit(True).alias("passed"),
    )
    return rates.unionByName(checks).unionByName(concentration)


def gate_failures(gates: DataFrame, target_rows: int) -> list[str]:
    """Messages of the failed gates; one short row per year or fact column."""
    messages = []
    for row in gates.where(~F.col("passed")).collect():
        if row.gate == "execution_rate" and row.value is None:
            messages.append(f"Execution rate undefined for {row.scope}: no PIM in the sample.")
        elif row.gate == "execution_rate":
            messages.append(f"Execution rate {row.value}% for {row.scope} is outside [0, 100].")
        elif row.gate == "row_target":
            messages.append(f"Sample holds {int(row.value):,} rows against a target of {target_rows:,}.")
        else:
            messages.append(f"Column '{row.scope}' has {int(row.value):,} null values.")
    return messages
