"""Silver cleaning: column names, amounts, text, imputed sector, late-file union."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from budgetstar.functions.text import fold_accents, is_blank, normalise_name, upper_clean
from budgetstar.model import MONEY, split_cell, text_columns

# Sector given to records without one, in the upper case of all cleaned text.
DEFAULT_SECTOR = "GL"
DEFAULT_SECTOR_NAME = "GOBIERNOS LOCALES (MUNICIPALIDADES)"


def rename_all(table: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    names = [rule(c) for c in table.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"Column names collide after renaming: {', '.join(repeated)}")
    return table.toDF(*names)


def clean_columns(table: DataFrame) -> DataFrame:
    return rename_all(table, normalise_name)


def clean_silver(table: DataFrame) -> DataFrame:
    """Normal names, exact amounts (unreadable text becomes NULL), stripped upper-case text."""
    named = clean_columns(table)

    def cleaned(field: StructField) -> Column:
        value = F.col(field.name)
        if not split_cell(field.name):
            return upper_clean(value).alias(field.name)
        return value if field.dataType == MONEY else value.try_cast(MONEY).alias(field.name)

    return named.select(*[cleaned(f) for f in named.schema.fields])


def clean_fold_accents(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The lower-case variant of the text rule; amounts are left alone."""
    chosen = set(text_columns(table.columns) if columns is None else columns)
    return table.select(*[fold_accents(F.col(c)).alias(c) if c in chosen else F.col(c) for c in table.columns])


def impute_sector(table: DataFrame) -> DataFrame:
    defaults = {"sector": DEFAULT_SECTOR, "sector_nombre": DEFAULT_SECTOR_NAME}
    return table.withColumns(
        {c: F.when(is_blank(F.col(c)), F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()}
    )


def present(amount: str = "monto") -> Column:
    """Amounts that count: neither NULL nor zero."""
    return F.col(amount).isNotNull() & (F.col(amount) != 0)


def has_amount(columns: Sequence[str]) -> Column:
    """True for records that leave at least one row in the long table."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) != 0, F.lit(False)) for c in columns])


def union_layers(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables written at different times; a column missing in one of them is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
