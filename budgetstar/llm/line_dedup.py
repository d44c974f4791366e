"""Repeated lines: two Bloom filters find suspects, suspects are confirmed by their bytes.

The hash space is cut into ranges, each with a filter of hashes seen and a filter of hashes seen
again. A block of documents sends each of its line hashes once (twice if several of its documents
hold the line), so a line of a third of all documents is one number per block. What the second
filter knows is a suspect; suspected lines alone move with their bytes, combined inside each task,
to be counted and to find the largest ``doc_id``. Suspects and decisions go back as notes to the
blocks they came from, and the texts are read where they lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetstar.llm.located import BLOCK_BITS, Notes, by_block, keep_notes, located, text_bytes
from budgetstar.llm.text import pieces, plain, texts_of, unused

LEAST_CHARS, LEAST_DOCS = 40, 5
RANGE_BYTES = 4 << 20  # text whose line hashes share a pair of filters
BITS_EACH, PROBES = 16, 4  # bits of a filter per hash, bits that a hash sets
CHUNK = 1 << 16  # hashes that enter the filters at once
BLANKS = b" \t\n\x0b\x0c\r"  # stripped from both ends of a line
_PAIR = np.dtype([("high", ">u8"), ("low", ">u8")])


def key_of(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """The key of a line, or None if it has fewer than ``least`` code points."""
    key = line.strip(BLANKS)
    if len(key) < least or not key.isascii() and len(key.decode()) < least:
        return None
    return key.lower()  # of bytes: A-Z only


class FilterPair:
    """Bloom filters of hashes seen and of hashes seen again; they never miss a repeated hash."""

    def __init__(self, entries: int) -> None:
        self.size = 1 << max(6, (BITS_EACH * max(1, entries) - 1).bit_length())
        self.once, self.twice = np.zeros(self.size, bool), np.zeros(self.size, bool)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) | np.uint64(1)
        probe = np.arange(PROBES, dtype=np.uint64)[:, None]
        return ((hashes + probe * step) & np.uint64(self.size - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for at in range(0, len(hashes), CHUNK):
            new, times = np.unique(hashes[at : at + CHUNK], return_counts=True)
            places = self._places(new)
            again = (times > 1) | self.once[places].all(axis=0)
            self.twice[places[:, again]] = True
            self.once[places] = True

    def suspected(self, hashes: np.ndarray) -> np.ndarray:
        return self.twice[self._places(hashes)].all(axis=0)


def _lines(text: bytes, least: int) -> dict[bytes, bytes]:
    """Digest and key of the distinct long lines of a text."""
    keys = {k for line in text.split(b"\n") if (k := key_of(line, least)) is not None} if len(text) >= least else ()
    return {xxhash.xxh3_128_digest(k): k for k in keys}


def _sent(ranges: int, least: int):
    """Line hashes of a task by range and block; a hash stands twice if two documents of the block hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = texts_of(batch.column("text"))
            parts = []
            for file, block, a, b in by_block(batch):
                digests = b"".join(d for t in texts[a:b] for d in _lines(t, least))
                hashes, times = np.unique(np.frombuffer(digests, _PAIR)["high"].astype(np.uint64), return_counts=True)
                if not len(hashes):
                    continue
                numbers = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
                times = np.minimum(times, 2)
                for x, y in zip(cuts[:-1], cuts[1:]):
                    parts.append((int(numbers[x]), file, block, np.repeat(hashes[x:y], times[x:y]).tobytes()))
            number, file, block, hashes = zip(*parts) if parts else ((), (), (), ())
            yield pa.RecordBatch.from_pydict(
                {
                    "range": pa.array(number, pa.int64()),
                    "file": pa.array(file, pa.int64()),
                    "block": pa.array(block, pa.int64()),
                    "hashes": pa.array(hashes, pa.binary()),
                }
            )

    return run


def _suspects(group: pa.Table) -> pa.Table:
    """Suspected hashes of one range, each once per block."""
    parts = [np.unique(np.frombuffer(h, np.uint64)) for h in group.column("hashes").to_pylist()]
    whole = [np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()]
    every = np.concatenate(whole)
    pair = FilterPair(len(every))
    pair.add(every)
    flat = np.concatenate(parts)
    found = pair.suspected(flat)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[found]
    return pa.table(
        {
            "file": group.column("file").take(pa.array(row)),
            "block": group.column("block").take(pa.array(row)),
            "hash": pa.array(flat[found].view(np.int64)),
        }
    )


def _confirmable(suspects: Notes, least: int):
    """Suspected lines with their bytes, once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = suspects.reader()
        for batch in pieces(batches):
            texts = texts_of(batch.column("text"))
            row, digests, keys = [], [], []
            for file, block, a, b in by_block(batch):
                if (notes := reader.of(file, block)) is None:
                    continue
                known = set(notes.column("hash").to_pylist())
                for at in range(a, b):
                    for digest, key in _lines(texts[at], least).items():
                        if int.from_bytes(digest[:8], "big", signed=True) in known:
                            row.append(at)
                            digests.append(digest)
                            keys.append(key)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
                    "hash": pa.array(np.frombuffer(b"".join(digests), _PAIR)["high"].astype(np.uint64).view(np.int64)),
                    "digest": pa.array(digests, pa.binary()),
                    "key": pa.array(keys, pa.binary()),
                }
            )

    return run


def decide(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> Notes:
    """Notes of the lines that go: ``digest`` of the key and ``keep``, the ``doc_id`` that keeps it.

    ``docs`` has ``doc_id``, ``text``, ``file`` and ``place``.
    """
    size = text_bytes(docs)
    ranges = max(1, -(-size // RANGE_BYTES))
    placed = docs.select("file", "place", "text")
    sent = placed.mapInArrow(_sent(ranges, least_chars), "range bigint, file bigint, block bigint, hashes binary")
    found = sent.groupBy("range").applyInArrow(_suspects, "file bigint, block bigint, hash bigint")
    suspects = keep_notes(found, size)

    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = docs.select("file", "place", "doc_id", "text").mapInArrow(
        _confirmable(suspects, least_chars), f"doc_id {kind}, hash bigint, digest binary, key binary"
    )
    counted = lines.groupBy("hash", "digest", "key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
    repeated = counted.where(F.col("n") >= least_docs).select("hash", "digest", "keep")
    blocks = docs.sparkSession.read.schema("file bigint, block bigint, hash bigint").parquet(suspects.folder).distinct()
    return keep_notes(blocks.join(repeated, "hash").select("file", "block", "digest", "keep"), size)


def _kept(doc_id: object, text: bytes, gone: dict[bytes, object], least: int) -> tuple[list[bytes], int]:
    """Lines that stay, and the number of lines before."""
    lines = text.split(b"\n")
    if not gone:
        return lines, len(lines)
    stay = []
    for line in lines:
        key = key_of(line, least)
        digest = None if key is None else xxhash.xxh3_128_digest(key)
        if digest is None or digest not in gone or gone[digest] == doc_id:
            stay.append(line)
    return stay, len(lines)


def _cleaned(batch: pa.RecordBatch, reader, least: int, key: str, text: str) -> Iterator[tuple[list[bytes], int]]:
    texts = texts_of(batch.column(text))
    ids = batch.column(key).to_pylist()
    for file, block, a, b in by_block(batch):
        notes = reader.of(file, block)
        gone = {} if notes is None else dict(zip(notes.column("digest").to_pylist(), notes.column("keep").to_pylist()))
        for at in range(a, b):
            yield _kept(ids[at], texts[at], gone, least)


def report(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: ``n_lines`` before, ``n_dropped`` and ``kept_sha256`` of the lines that stay.

    Null text counts as empty, which is one empty line. Every input row is a document, repeated rows
    too; rows that share the largest ``doc_id`` all keep the line. A null ``doc_id`` is smaller than
    any other. A line that goes, goes wherever it stands in the document.
    """
    docs = located(plain(docs, key, text))
    notes = decide(docs, least_chars, least_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = notes.reader()
        for batch in pieces(batches):
            rows = [(n, n - len(s), hashlib.sha256(b"\n".join(s)).hexdigest()) for s, n in _cleaned(batch, reader, least_chars, "doc_id", "text")]
            lines, dropped, digest = zip(*rows)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_lines": pa.array(lines, pa.int64()),
                    "n_dropped": pa.array(dropped, pa.int64()),
                    "kept_sha256": pa.array(digest, pa.string()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, repeated lines taken out of the text; a null text stays null."""
    file, place = unused(docs.columns, "file"), unused(docs.columns, "place")
    placed = located(docs, file, place)
    lean = placed.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(file).alias("file"), F.col(place).alias("place"))
    notes, names = decide(lean, least_chars, least_docs), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = notes.reader()
        for batch in pieces(batches):
            where = pa.RecordBatch.from_arrays([batch.column(c) for c in (file, place, key, text)], names=["file", "place", "key", "text"])
            column = batch.column(text)
            new = [b"\n".join(s) for s, _ in _cleaned(where, reader, least_chars, "key", "text")]
            new = pa.array([None if m else t.decode() for t, m in zip(new, column.is_null().to_pylist())], column.type)
            yield pa.RecordBatch.from_arrays([new if c == text else batch.column(c) for c in names], names=names)

    return placed.mapInArrow(run, docs.schema)
