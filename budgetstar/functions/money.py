"""Ratios, scaled amounts and display labels over exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Execution tiers in percent.
GOOD_RATE, FAIR_RATE = 75.0, 40.0

# Scales of the currency label, largest first.
CURRENCY_SCALES = (
    (1_000_000_000_000, "0.000000000001", " T"),
    (1_000_000_000, "0.000000001", " B"),
    (1_000_000, "0.000001", " M"),
)

WIDE_MONEY = "decimal(24,2)"


def as_double(column: Column) -> Column:
    return column.cast("double")


def exact(text: str) -> Column:
    """A decimal literal with the scale it is written with."""
    digits = text.replace(".", "").lstrip("-")
    scale = len(text.split(".")[1]) if "." in text else 0
    return F.lit(text).cast(f"decimal({max(len(digits), scale + 1)},{scale})")


def rate_pct(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; 0 when the whole is not positive."""
    return F.when(whole > 0, as_double(part) / as_double(whole) * 100.0).otherwise(F.lit(0.0))


def rate_pct_or_null(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL when the whole is 0 or NULL."""
    return F.when(whole != 0, as_double(part) / as_double(whole) * 100.0)


def unexecuted_gap(planned: Column, executed: Column) -> Column:
    return F.greatest(planned - executed, F.lit(0))


def billions(amount: Column) -> Column:
    """Amount in billions, rounded half up to two places, still a decimal."""
    return F.round(amount.cast(WIDE_MONEY) * exact("0.000000001"), 2)


def short_number(rounded: Column) -> Column:
    """A two-place decimal as text with one trailing zero dropped: 20.50 -> 20.5, 20.00 -> 20.0."""
    return F.regexp_replace(rounded.cast("decimal(28,2)").cast("string"), "0$", "")


def percent_text(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent as text such as ``20.5 %``; NULL when the whole is 0 or NULL."""
    return F.concat(short_number(rounded_pct(part, whole)), F.lit(" %"))


def rounded_pct(part: Column, whole: Column) -> Column:
    ratio = F.try_divide(part.cast(WIDE_MONEY) * F.lit(100), whole.cast(WIDE_MONEY))
    return F.round(ratio, 2)


def currency_label(amount: Column) -> Column:
    value = amount.cast(WIDE_MONEY)
    label = F.concat(F.lit("S/. "), F.format_number(value, 2))
    for floor, factor, suffix in reversed(CURRENCY_SCALES):
        scaled = F.round(value * exact(factor), 2)
        label = F.when(
            F.abs(value) >= floor, F.concat(F.lit("S/. "), F.format_number(scaled, 2), F.lit(suffix))
        ).otherwise(label)
    return label


def execution_tier(rate: Column) -> Column:
    return F.when(rate >= GOOD_RATE, "success").when(rate >= FAIR_RATE, "warning").otherwise("danger")


def target_gap(rate: Column) -> Column:
    return rate - F.lit(GOOD_RATE)
