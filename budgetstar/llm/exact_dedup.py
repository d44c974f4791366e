"""Exact duplicates: fingerprints are counted in quotient filters, repeated ones are verified byte by byte.

Every task counts the fingerprints of its rows in counting quotient filters, one per range of
quotients, so a text with any number of copies is one entry per task. Filters of a range merge
without loss. Places of texts whose fingerprint has a count above one are noted; a second scan sends
those texts, and no others, to a grouping by the text itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetstar.llm import quotient_filter as qf
from budgetstar.llm.located import Notes, flag, flagged, located, text_bytes, without
from budgetstar.llm.text import pieces, plain, texts_of, unused
from budgetstar.sources.shared import cut_lineage

BLOCK_BITS = 16  # quotients per filter: 65,536, about as many entries


def normalize(text: bytes) -> bytes:
    """A-Z lower-cased, all else untouched."""
    return text.lower()


def fingerprint(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = [normalize(t) for t in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "file": batch.column("file"),
                "place": batch.column("place"),
                "fingerprint": pa.array(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)),
                "sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            }
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, place, ``fingerprint`` and ``sha256`` of the normalised text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select("doc_id", "text", "file", "place")
    return placed.mapInArrow(_prints, f"doc_id {kind}, file bigint, place bigint, fingerprint bigint, sha256 string")


def _texts(notes: Notes):
    """Normalised texts of the noted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(flagged(batches, notes)):
            texts = [normalize(t).decode("utf-8", "surrogatepass") for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return run


def quotient_bits(rows: int) -> int:
    """Twice as many quotients as rows."""
    return max(1, (2 * max(1, rows) - 1).bit_length())


def _split(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    remainders = ((prints >> np.uint64(64 - bits - qf.REMAINDER_BITS)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return prints >> np.uint64(64 - bits), remainders


def _count(bits: int):
    shift = np.uint64(min(bits, BLOCK_BITS))

    def filters(prints: np.ndarray) -> pa.RecordBatch:
        quotients, remainders = _split(prints, bits)
        quotients, remainders, counts = qf.merge_sorted(quotients, remainders, np.ones(len(prints), np.uint64))
        blocks = quotients >> shift
        cuts = np.r_[np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]), len(blocks)]
        parts = [qf.encode(quotients[a:b], remainders[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_pydict(
            {"block": pa.array(blocks[cuts[:-1]].astype(np.int64)), "filter": pa.array(parts, pa.binary())}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= 1 << 20:  # memory of a task stays bounded; more filters per block merge all the same
                yield filters(np.concatenate(held))
                held, n = [], 0
        if n:
            yield filters(np.concatenate(held))

    return run


def _repeated(bits: int):
    def run(block: pa.Table) -> pa.Table:
        parts = [qf.decode(f) for f in block.column("filter").to_pylist()]
        quotients, remainders, counts = qf.merge_sorted(*(np.concatenate(x) for x in zip(*parts)))
        keep = counts > 1
        prefix = (quotients[keep] << np.uint64(qf.REMAINDER_BITS)) | remainders[keep].astype(np.uint64)
        return pa.table({"prefix": pa.array(prefix.astype(np.int64)), "copies": pa.array(counts[keep].astype(np.int64))})

    return run


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """``prefix`` (quotient and remainder) and ``copies`` of fingerprints that occur more than once."""
    bits = min(quotient_bits(rows), 64 - qf.REMAINDER_BITS - 1)
    parts = prints.select("fingerprint").mapInArrow(_count(bits), "block bigint, filter binary")
    return parts.groupBy("block").applyInArrow(_repeated(bits), "prefix bigint, copies bigint")


def repeated_texts(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Verified groups of equal texts: ``sha256``, ``keep_id`` and ``group_size``.

    Only fingerprints and places meet the repeated ones, and only texts with a repeated fingerprint
    are grouped; a unique text among them forms a group of one. The grouping combines equal texts
    inside each task first, so a group of any size sends one text per task.
    """
    rows = prints.count()
    width = min(quotient_bits(rows), 64 - qf.REMAINDER_BITS - 1) + qf.REMAINDER_BITS
    repeated = repeated_fingerprints(prints, rows).select("prefix")
    places = prints.select("file", "place", F.shiftrightunsigned("fingerprint", 64 - width).alias("prefix"))
    notes = flag(places.join(repeated, "prefix", "left_semi"), text_bytes(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", "file", "place").mapInArrow(_texts(notes), f"doc_id {kind}, text string")
    groups = texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.where("group_size > 1").select(F.sha2("text", 256).alias("sha256"), "keep_id", "group_size")


def find_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the row that stays for its text, and how many rows share the text.

    Null text counts as empty; a null ``doc_id`` stays only if its group has no other. Of rows that
    share text and ``doc_id`` all are marked kept, ``drop_copies`` leaves one of them.
    """
    docs = located(plain(docs, key, text))
    prints = cut_lineage(fingerprints(docs))
    groups = repeated_texts(docs, prints)
    joined = prints.join(groups, "sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    The places of all rows that go are noted; the rows are read again and none of them moves.
    """
    file, place = unused(docs.columns, "file"), unused(docs.columns, "place")
    placed = located(docs, file, place)
    lean = placed.select(
        F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(file).alias("file"), F.col(place).alias("place")
    )
    prints = cut_lineage(fingerprints(lean))
    groups = cut_lineage(repeated_texts(lean, prints))
    members = prints.select("doc_id", "sha256", "file", "place").join(groups.select("sha256", "keep_id"), "sha256")
    at = F.struct("file", "place")
    stays = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha256").agg(F.min(at).alias("stays"))
    gone = prints.select("sha256", "file", "place").join(stays, "sha256").where(at != F.col("stays"))
    return without(placed, flag(gone, text_bytes(lean)), docs.columns, file, place)
