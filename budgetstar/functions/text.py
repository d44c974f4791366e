"""Text cleaning: column names on the driver, column values on the executors."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters stripped from both ends of descriptive values.
ASCII_WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE = ASCII_WHITE_SPACE + (
    "\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def normalise_name(name: str) -> str:
    """``' Año Ñ '`` -> ``'_ano_n_'``: lower case, no accents, blanks to ``_``, nothing else kept."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9_]", "", re.sub(r"\s+", "_", plain))


def stripped(column: Column) -> Column:
    """Both ends without white space.

    Plain ASCII text, nearly all of it, is checked against the six ASCII blanks only: a search in
    the whole set for each end costs twice as much.
    """
    ascii_only = F.octet_length(column) == F.length(column)
    return F.when(ascii_only, F.trim(column, F.lit(ASCII_WHITE_SPACE))).otherwise(
        F.trim(column, F.lit(WHITE_SPACE))
    )


def upper_clean(column: Column) -> Column:
    return F.upper(stripped(column.cast("string")))


def fold_accents(column: Column) -> Column:
    """Lower case with the five accented vowels written plain; other letters stay."""
    return F.translate(F.lower(stripped(column.cast("string"))), "áéíóú", "aeiou")


def is_blank(column: Column) -> Column:
    """True for NULL and for white space only."""
    return F.coalesce(stripped(column), F.lit("")) == ""


def label_or_unspecified(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("Unspecified"))
