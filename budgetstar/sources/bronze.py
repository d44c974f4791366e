"""Bronze layer: CSV files to Parquet, every value kept as text unless a schema is given."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetstar.model import MONEY
from budgetstar.operators.clean import rename_all
from budgetstar.sources.parquet import write_layer
from budgetstar.sources.shared import cut_lineage

TEXT_TYPE = "Carácter"  # fixed value: how the data dictionary marks text variables


class UnknownColumnsError(ValueError):
    """A file brings columns that the given schema does not have."""


_CSV = {"mode": "PERMISSIVE", "escape": '"'}


def _reader(spark: SparkSession) -> DataFrameReader:
    return spark.read.options(header=True, enforceSchema=False, **_CSV)


def _lines(spark: SparkSession, path: str | Sequence[str], ends: str | None = None) -> DataFrame:
    """Lines with their file, where their split of the file starts, and their order in it.

    ``opens`` says whether a quoted field is open at the end of a line that starts outside one,
    ``stays`` whether one is if the line starts inside. Runs of quotes are cut to one or none first,
    because two of them stand for one in a field.
    """
    reader = spark.read.option("lineSep", ends) if ends else spark.read
    read = reader.text(path if isinstance(path, str) else list(path))
    single = F.regexp_replace("value", '""', "")
    behind = F.regexp_replace(F.regexp_replace(single, '^[^"]*"', ""), "^[^,]*", "")
    quoted = F.contains("value", F.lit('"'))
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        "value",
        (quoted & _ends_open(single)).alias("opens"),
        (~F.contains(single, F.lit('"')) | _ends_open(behind)).alias("stays"),
    )


def _ends_open(text: Column) -> Column:
    """A quote opens a field at its start only; closed fields are taken out first."""
    return F.regexp_replace(text, '(?<![^,])"[^"]*"', "").rlike('(?<![^,])"')


@dataclass(frozen=True)
class CsvFile:
    path: str
    header: tuple[str, ...]
    broken: bool  # holds fields with line breaks


def inspect_files(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> list[CsvFile]:
    """Files with content, their columns as written, and whether a record may go over several lines.

    One job for any number of files: each task reduces its lines to one row per file.
    """
    first = F.min(F.struct("start", "id", "value"))["value"]
    try:
        lines = _lines(spark, path).where(F.trim("value") != "")
        found = lines.groupBy("file").agg(first.alias("first"), F.max("opens").alias("broken")).collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"CSV not found: {path}") from error
        raise
    broken = {r.file: r.first for r in found if r.broken and multi_line}
    whole = _first_records(spark, sorted(broken)) if any(t.count('"') % 2 for t in broken.values()) else broken
    return sorted((CsvFile(r.file, _split(whole.get(r.file, r.first)), r.file in broken) for r in found), key=lambda f: f.path)


def _first_records(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """First records of files whose header may hold a line break."""
    records = assembled(spark, files, drop_first=False).groupBy("file").agg(F.min_by("record", "id").alias("record"))
    return {r.file: r.record for r in records.collect()}


def _split(header: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([header], strict=False)))


def assembled(spark: SparkSession, files: list[str], drop_first: bool = True) -> DataFrame:
    """``file``, ``id`` and ``record``: whole records of files whose fields hold line breaks, read in parallel.

    Each line maps the state it starts in, outside or inside a quoted field, to the state it ends in.
    Such maps compose, so the state at the start of every split follows from one row per split; then
    each split is worked through on its own. Lines of records that go over several lines are grouped,
    all others pass. Lines are written first, so that their order is the same in both passes.
    """
    lines = cut_lineage(_lines(spark, files, "\n"))
    inside = _state(lines.drop("value"), ["file", "start"], "id")
    ends = F.max_by(F.struct(*[F.when(_before(F.lit(s)), F.col("stays")).otherwise(F.col("opens")).alias(n) for n, s in _BOTH]), "id")
    begins = [F.max(F.when(~_before(F.lit(s)), F.col("id"))).alias(f"last_{n}") for n, s in _BOTH]
    splits = inside.groupBy("file", "start").agg(ends.alias("ends"), *begins)
    splits = splits.select("file", "start", "last_opens", "last_stays", F.col("ends.opens").alias("opens"), F.col("ends.stays").alias("stays"))
    placed = _state(splits, ["file"], "start").withColumn("starts_inside", _before(F.lit(False)))
    last = F.when(F.col("starts_inside"), F.col("last_stays")).otherwise(F.col("last_opens"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(F.col("file").alias("f"), F.col("start").alias("s"), "starts_inside", F.last(last, True).over(earlier).alias("carried"))

    met = lines.join(placed, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
    met = _state(met, ["file", "start"], "id").withColumn("before", _before(F.col("starts_inside")))
    so_far = Window.partitionBy("file", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.coalesce(F.last(F.when(~F.col("before"), F.col("id")), True).over(so_far), F.col("carried"))
    met = met.withColumn("owner", owner)
    alone = met.where(~F.col("before") & ~F.col("opens")).select("file", "id", F.col("value").alias("record"))
    several = met.where(F.col("before") | F.col("opens")).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    whole = alone.unionByName(several.select("file", F.col("owner").alias("id"), joined.alias("record")))
    whole = whole.where(F.trim(F.regexp_replace("record", "[\r\n]", "")) != "")
    if not drop_first:
        return whole
    first = lines.where((F.col("start") == 0) & (F.trim(F.regexp_replace("value", "\r", "")) != "")).groupBy("file").agg(F.min("id").alias("id"))
    return whole.join(first, ["file", "id"], "left_anti")


_BOTH = (("opens", False), ("stays", True))  # the states a split can start in


def _state(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What the rows before each one do to a state: ``fixed`` if they end in one whatever came, and ``odd`` turns after it."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(F.col("opens") & ~F.col("stays"), 1).otherwise(0)).over(earlier), F.lit(0))
    constant = F.col("opens") == F.col("stays")
    counted = rows.withColumn("turns", turns)
    fixed = F.last(F.when(constant, F.col("opens")), True).over(earlier)
    since = F.coalesce(F.last(F.when(constant, F.col("turns")), True).over(earlier), F.lit(0))
    return counted.withColumns({"fixed": fixed, "odd": (F.col("turns") - since) % 2 == 1}).drop("turns")


def _before(start: Column) -> Column:
    """The state before a row, from the state before all rows."""
    return F.coalesce(F.col("fixed"), start) != F.col("odd")


def scan_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """One file, a folder, a glob or a list of files as one table; columns meet by name.

    Header blanks are stripped. Files are read per header, so their columns may come in any order;
    a column that only some files have is NULL in the others. Without a schema all columns are
    text and no pass is spent on inference. With one, values are read in its types (unreadable ones
    become NULL, see ``rejected_values``), its columns are returned in its order, and a file with any
    other column raises ``UnknownColumnsError`` that names file and columns.

    Files of any size are split: one job finds headers and files whose quoted fields hold line
    breaks, records of those are put together from lines in parallel. ``multi_line=False`` takes
    every line for a record.
    """
    files = inspect_files(spark, path, multi_line)
    if not files:
        raise FileNotFoundError(f"No CSV file with content: {path}")
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = defaultdict(list)
    for file in files:
        groups[file.header, file.broken].append(file.path)
    if schema is not None:
        _check_columns(files, schema)
    frames = [_read_group(spark, header, same, schema, broken) for (header, broken), same in sorted(groups.items())]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if schema is None:
        return whole
    kinds = {f.name.strip(): f.dataType for f in schema.fields}
    return whole.select(*[(F.col(f"`{c}`") if c in whole.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])


def _check_columns(files: list[CsvFile], schema: T.StructType) -> None:
    known = {n.strip() for n in schema.names}
    strange = {f.header: (f.path, sorted({c.strip() for c in f.header} - known)) for f in reversed(files)}
    told = "; ".join(f"{file}: {', '.join(columns)}" for file, columns in sorted(strange.values()) if columns)
    if told:
        raise UnknownColumnsError(f"Columns that the schema does not have: {told}")


def _read_group(spark: SparkSession, header: Sequence[str], files: list[str], schema: T.StructType | None, broken: bool) -> DataFrame:
    kinds = {} if schema is None else {f.name.strip(): f.dataType for f in schema.fields}
    typed = T.StructType([T.StructField(c, kinds.get(c.strip(), T.StringType())) for c in header])
    if not broken:
        return strip_headers(_reader(spark).schema(typed).csv(files))
    plain = T.StructType([T.StructField(f"_{n}", f.dataType) for n, f in enumerate(typed.fields)])
    read = F.from_csv(F.regexp_replace("record", "\\r$", ""), F.lit(plain.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), _CSV)
    return strip_headers(assembled(spark, files).select(read.alias("r")).select("r.*").toDF(*header))


def rejected_values(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, keys: Sequence[str], multi_line: bool = True) -> DataFrame:
    """Values that the schema's types cannot hold: the record's key columns, ``column`` and ``text``.

    ``scan_csv`` with the same schema reads them as NULL. A record gives one row per such value; of
    every column, readable, rejected and missing values add up to the records delivered.
    """
    text = scan_csv(spark, path, T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]), multi_line)
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    bad = [
        F.when(F.col(f"`{n}`").try_cast(f.dataType).isNull() & F.col(f"`{n}`").isNotNull(), F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("text")))
        for f in typed
        if (n := f.name.strip())
    ]
    if not bad:
        return text.select(*keys, F.lit("").alias("column"), F.lit("").alias("text")).limit(0)
    return text.select(*keys, F.inline(F.filter(F.array(*bad), lambda b: b.isNotNull())))


def strip_headers(source: DataFrame) -> DataFrame:
    return rename_all(source, str.strip)


def write_csv(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header that ``scan_csv`` reads back unchanged: blanks and line breaks are kept."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table.write.mode(mode).options(**options).csv(path)


def ingest_csv(spark: SparkSession, path: str | Sequence[str], target: str) -> DataFrame:
    """Copy CSV files to a Parquet table and return the table."""
    return write_layer(scan_csv(spark, path), target)


def text_variables(dictionary: DataFrame) -> list[str]:
    """Variables the data dictionary declares as text; one short row per source column."""
    rows = dictionary.where(F.trim("TIPO_DATO") == TEXT_TYPE).select("VARIABLE").collect()
    return [r.VARIABLE for r in rows]


def schema_from_dictionary(dictionary: DataFrame, columns: list[str]) -> T.StructType:
    """Text for declared variables (codes keep their leading zeros), exact amounts for all others."""
    text = set(text_variables(dictionary))
    return T.StructType([T.StructField(c, T.StringType() if c.strip() in text else MONEY) for c in columns])


def apply_dictionary(source: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Cast an all-text table to the dictionary schema; unreadable numbers become NULL."""
    schema = schema_from_dictionary(dictionary, source.columns)
    return source.select(
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )
