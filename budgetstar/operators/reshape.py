"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetstar.functions.keys import long_row_key
from budgetstar.model import split_cell
from budgetstar.operators.clean import present


def unpivot_phases(
    wide: DataFrame,
    ids: Sequence[str] | None = None,
    years: Iterable[int] | None = None,
    phases: Iterable[str] | None = None,
) -> DataFrame:
    """One row per record, year and phase with a non-zero amount.

    Year and phase come from the column name once, when the plan is built, and are literals of the
    generator, so no row parses text. Cells outside ``years``/``phases`` are never generated (nor,
    on Parquet, read). Rows stream through one stage; nothing is shuffled.
    """
    cells = {c: split_cell(c) for c in wide.columns if split_cell(c)}
    keep_years = None if years is None else set(years)
    keep_phases = None if phases is None else set(phases)
    cells = {
        c: (phase, year)
        for c, (phase, year) in cells.items()
        if (keep_years is None or year in keep_years) and (keep_phases is None or phase in keep_phases)
    }
    if not cells:
        raise ValueError("No phase_year column to unpivot")
    kept = [c for c in wide.columns if not split_cell(c)] if ids is None else list(ids)
    arguments = [e for c, (phase, year) in cells.items() for e in (F.lit(year), F.lit(phase), F.col(c))]
    long = wide.select(*kept, F.stack(F.lit(len(cells)), *arguments).alias("anio", "fase", "monto"))
    return long.where(present("monto"))


def with_row_key(long: DataFrame, key: str = "key_value") -> DataFrame:
    return long.select(long_row_key(key).alias("sk_silver_id"), "*")


def pivot_years(
    table: DataFrame, label: str, year: str, value: str, years: Sequence[int], prefix: str = "y"
) -> DataFrame:
    """Label by year matrix with 0 for missing cells, labels in descending order.

    The year list is given, so the pivot needs no extra pass to find it.
    """
    matrix = (
        table.groupBy(label)
        .pivot(year, list(years))
        .agg(F.first(value))
        .na.fill(0.0, [str(y) for y in years])
    )
    renamed = matrix.select(label, *[F.col(str(y)).alias(f"{prefix}{y}") for y in years])
    return renamed.orderBy(F.col(label).desc())
