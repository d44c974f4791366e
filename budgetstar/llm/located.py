"""Rows by their place in files, and notes about places that a second scan reads back.

An operator that decides about rows after a shuffle has to bring its decisions back to the texts.
Here only the decisions move: a row is known by the file and the number of the row in it, notes are
written to the shared folder in buckets of places, and a task of the second scan reads the notes of
its own places. Texts stay where they are, nothing is broadcast, and no size is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetstar.llm.text import pieces
from budgetstar.sources.shared import application_folder, cut_lineage

BLOCK_BITS, CHUNK_BITS = 12, 6  # rows of a file in a block, blocks in a chunk that is read at once
BUCKET_BYTES = 256 << 20  # text that shares a bucket of notes
PASSED_BYTES = 4 << 20  # of rows that pass a task at once
_PASSING = ("Project", "Filter", "SubqueryAlias")
_PLACED = {"s3a": "s3", "s3n": "s3"}  # names that Hadoop has for a store
_KNOWN = ("file", "s3", "gs", "gcs", "hdfs", "viewfs", "abfs", "abfss", "mock")


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it of a local path or an address as Hadoop writes it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.FileSystem.from_uri(f"file://{path}")
    scheme = _PLACED.get(scheme, scheme)
    if scheme not in _KNOWN:
        raise ValueError(f"Tasks cannot write to {path}: set spark.checkpoint.dir to a local, s3a, gs, abfs or hdfs folder")
    return fs.FileSystem.from_uri(f"{scheme}:{rest}")


def _scans_files(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in _PASSING:
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") and "parquet" in plan.simpleString(200).lower()


def located(docs: DataFrame, file: str = "file", place: str = "place") -> DataFrame:
    """All columns, and where each row stands: a hash of its file, the number of its row.

    A table that is more than a scan of Parquet files is written to the shared folder first.
    """
    if not _scans_files(docs):
        docs = cut_lineage(docs)
    return docs.select(
        "*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)
    )


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("bigint"))).first()[0] or 0


@dataclass(frozen=True)
class Notes:
    """Notes in the shared folder: rows of ``file``, ``block`` and any other columns."""

    folder: str
    buckets: int

    def reader(self) -> NoteReader:
        return NoteReader(self)


def keep_notes(notes: DataFrame, corpus_bytes: int) -> Notes:
    """Write notes by bucket, sorted by place, so that a task reads few row groups."""
    folder = f"{application_folder(notes.sparkSession)}/notes-{uuid.uuid4().hex[:12]}"
    buckets = max(1, -(-corpus_bytes // BUCKET_BYTES))
    chunk = F.col("file").bitwiseXOR(F.shiftright("block", CHUNK_BITS))
    dealt = notes.withColumn("bucket", F.pmod(chunk, F.lit(buckets)))
    dealt = dealt.repartition(buckets, "bucket", "file", F.shiftright("block", CHUNK_BITS))
    writer = dealt.sortWithinPartitions("bucket", "file", "block").write.partitionBy("bucket")
    writer.option("compression", "zstd").option("parquet.block.size", 1 << 20).parquet(folder)
    return Notes(folder, buckets)


def flag(places: DataFrame, corpus_bytes: int) -> Notes:
    """Notes of single rows, given as ``file`` and ``place``."""
    return keep_notes(places.select("file", F.shiftright("place", BLOCK_BITS).alias("block"), "place"), corpus_bytes)


def flagged(batches: Iterator[pa.RecordBatch], notes: Notes, wanted: bool = True, file: str = "file", place: str = "place") -> Iterator[pa.RecordBatch]:
    """The rows of a scan that are flagged, or all others."""
    reader = notes.reader()
    for batch in pieces(batches, PASSED_BYTES):  # whole rows pass: small batches keep the memory of both sides small
        keep = np.full(batch.num_rows, not wanted)
        where = pa.RecordBatch.from_arrays([batch.column(file), batch.column(place)], names=["file", "place"])
        places = where.column("place").to_numpy()
        for number, block, a, b in by_block(where):
            if (found := reader.of(number, block)) is not None:
                keep[a:b] = np.isin(places[a:b], found.column("place").to_numpy()) == wanted
        if keep.any():
            yield batch if keep.all() else batch.filter(pa.array(keep))
    pa.default_memory_pool().release_unused()


def without(placed: DataFrame, notes: Notes, names: list[str], file: str, place: str) -> DataFrame:
    """The rows that are not flagged, with the columns ``names``; no row is moved."""
    schema = placed.select(*[F.col(f"`{c}`") for c in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flagged(batches, notes, False, file, place):
            yield batch.select(names)

    return placed.mapInArrow(run, schema)


class NoteReader:
    """Notes of one block at a time; a scan goes through the blocks of a file in order."""

    def __init__(self, notes: Notes) -> None:
        self.notes, (self.store, self.root) = notes, open_store(notes.folder)
        self.chunk: tuple[int, int] | None = None
        self.table: pa.Table | None = None
        self.blocks = np.empty(0, np.int64)

    def of(self, file: int, block: int) -> pa.Table | None:
        chunk = (file, block >> CHUNK_BITS)
        if chunk != self.chunk:
            self.chunk, self.table = chunk, self._read(*chunk)
            self.blocks = np.empty(0, np.int64) if self.table is None else self.table.column("block").to_numpy()
        low, high = np.searchsorted(self.blocks, [block, block + 1])
        return self.table.slice(low, high - low) if high > low else None

    def _read(self, file: int, chunk: int) -> pa.Table | None:
        path = f"{self.root}/bucket={(file ^ chunk) % self.notes.buckets}"
        if self.store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        first = chunk << CHUNK_BITS
        wanted = (pd.field("file") == file) & (pd.field("block") >= first) & (pd.field("block") < first + (1 << CHUNK_BITS))
        return pd.dataset(path, filesystem=self.store, format="parquet").to_table(filter=wanted).sort_by("block")


def by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """Runs of rows of one block: file, block, first row, end."""
    files = batch.column("file").to_numpy()
    blocks = batch.column("place").to_numpy() >> BLOCK_BITS
    new = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, b in zip([0, *new.tolist()], [*new.tolist(), len(files)]):
        if b > a:
            yield int(files[a]), int(blocks[a]), a, b
