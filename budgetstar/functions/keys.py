"""Stable keys and orders derived from column values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK = "~"


def key_text(columns: Sequence[str]) -> Column:
    """``_``-joined codes with NULL written as ``~``, so (A, NULL, B) and (A, B, NULL) differ."""
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in columns])


def hash60(text: Column) -> Column:
    """First 60 bits of md5 as a non-negative BIGINT; any engine with md5 gives the same value."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def surrogate_key(columns: Sequence[str]) -> Column:
    return hash60(key_text(columns))


def shuffled_order(columns: Sequence[str]) -> Column:
    """Text that orders rows in a repeatable pseudo-random way."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def long_row_key(key: str = "key_value") -> Column:
    return hash60(
        F.concat_ws("_", F.coalesce(F.col(key), F.lit(NULL_MARK)), F.col("anio").cast("string"), F.col("fase"))
    )
