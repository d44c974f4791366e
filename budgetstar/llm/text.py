"""Words, segments and column names shared by the text operators."""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters outside these ASCII ranges, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The Unicode property White_Space, as public tokenizers read \s.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Bytes of UTF-8: everything from 0x80 on belongs to a word, so a byte table is enough.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(_FOLD).split()


def segments(text: str) -> list[str]:
    """The text cut before each run of white space that follows something else.

    No pre-token of the public byte-level patterns spans such a place, so segments can be
    tokenized one by one.
    """
    return _SEGMENT.findall(text)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def lower_ascii(text: Column) -> Column:
    """Lower case in which only A-Z become ASCII letters.

    The two characters whose lower case holds an ASCII letter are replaced by another letter, so
    word borders and ASCII words are those of the text with A-Z folded.
    """
    kept = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")), F.lit("\u0130"), F.lit("\u00e9"))
    return F.lower(kept)


def unused(columns: Iterable[str], name: str) -> str:
    """A column name like ``name`` that the table does not have, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def plain(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, under these names."""
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about ``most`` bytes of text or one row."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, int(rows * most / max(1, batch.nbytes)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def literal_rows(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A small table known when the plan is built, as one SQL literal."""
    listed = F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(listed))


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """An object made once per Python worker process; Spark reuses a process for many tasks.

    Meant for bounded caches whose content never changes a result. A process keeps the one asked for
    last, so an application that goes through many operators holds no more than one of them.
    """
    held = sys.modules.setdefault("budgetstar_worker_state", types.ModuleType("budgetstar_worker_state"))
    if getattr(held, "key", None) != key:
        held.key, held.value = key, None
        pa.default_memory_pool().release_unused()
        held.value = make()
    return held.value
