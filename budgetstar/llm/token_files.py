"""Token ids in seekable files of independent zstandard frames.

A file is a row of frames, each holding the ids of some whole documents, then a skippable frame that
lists the first document and the numbers of documents and ids of each frame, then a skippable frame
with the seek table of the public seekable format: sizes and a checksum per frame. A reader fetches
the tail, finds the frames of the wanted documents and decompresses those only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from budgetstar.llm.encoding import encoder as encoder_of
from budgetstar.llm.encoding import filled
from budgetstar.llm.located import open_store
from budgetstar.llm.text import pieces, plain
from budgetstar.sources.shared import application_folder, cut_lineage

# Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE, CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 18  # ids after which a frame is closed; a longer document has a frame of its own
LEVEL = 3
_SEEK, _INDEX, _FOOT, _SKIP = "<III", "<qBIQ", "<IBI", "<II"  # layouts, for struct


class CorruptFrame(ValueError):
    """Bytes of a frame do not match its checksum."""


class Writer:
    """Writes one file; ids of documents have to come in the order they are to be stored."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, bool, int, int]] = []
        self.held: list[tuple[int | None, bytes]] = []
        self.waiting = self.docs = self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held.append((doc_id, ids))
        self.waiting += len(ids) // self.width
        if self.waiting >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        n = len(self.held)
        keys = np.array([0 if d is None else d for d, _ in self.held], "<i8").tobytes()
        missing = bytes(d is None for d, _ in self.held)
        sizes = np.array([len(i) // self.width for _, i in self.held], "<u4").tobytes()
        body = b"".join([struct.pack("<IB", n, self.width), keys, missing, sizes, *[i for _, i in self.held]])
        frame = self.packer.compress(body)
        self.out.write(frame)
        self.seek.append((len(frame), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        first = self.held[0][0]
        self.index.append((first or 0, first is None, n, self.waiting))
        self.docs += n
        self.ids += self.waiting
        self.held, self.waiting = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack(_INDEX, *x) for x in self.index)
        index += struct.pack("<I", zlib.crc32(index))
        self.out.write(struct.pack(_SKIP, SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack(_SEEK, *x) for x in self.seek) + struct.pack(_FOOT, len(self.seek), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack(_SKIP, SKIPPABLE_SEEK, len(table)) + table)


@dataclass
class Frame:
    at: int
    packed: int
    size: int
    checksum: int
    first: int | None
    docs: int
    ids: int
    start: int  # ids of the file before this frame


class Reader:
    """Reads the tail of a file once, then any frames."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        count, flags, magic = struct.unpack(_FOOT, self._bytes(end - struct.calcsize(_FOOT), struct.calcsize(_FOOT)))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise CorruptFrame("No seek table with checksums at the end of the file")
        seek_at = end - struct.calcsize(_FOOT) - count * struct.calcsize(_SEEK) - struct.calcsize(_SKIP)
        if struct.unpack(_SKIP, self._bytes(seek_at, struct.calcsize(_SKIP))) != (SKIPPABLE_SEEK, count * struct.calcsize(_SEEK) + struct.calcsize(_FOOT)):
            raise CorruptFrame("The seek table has another size than its footer says")
        seek = list(struct.iter_unpack(_SEEK, self._bytes(seek_at + struct.calcsize(_SKIP), count * struct.calcsize(_SEEK))))
        index = self._bytes(seek_at - count * struct.calcsize(_INDEX) - 4, count * struct.calcsize(_INDEX) + 4)
        if zlib.crc32(index[:-4]) != struct.unpack("<I", index[-4:])[0]:
            raise CorruptFrame("The document index does not match its checksum")
        self.frames, at, start = [], 0, 0
        for (packed, size, checksum), (first, missing, docs, ids) in zip(seek, struct.iter_unpack(_INDEX, index[:-4])):
            self.frames.append(Frame(at, packed, size, checksum, None if missing else first, docs, ids, start))
            at, start = at + packed, start + ids
        self.opened = 0

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def documents(self, frame: Frame) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, place in the file and ids of the documents of a frame."""
        self.opened += 1
        try:
            body = zstandard.ZstdDecompressor().decompress(self._bytes(frame.at, frame.packed), max_output_size=frame.size)
        except zstandard.ZstdError as error:
            raise CorruptFrame(str(error)) from error
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != frame.checksum:
            raise CorruptFrame("A frame does not match its checksum")
        n, width = struct.unpack_from("<IB", body)
        keys = np.frombuffer(body, "<i8", n, 5).tolist()
        missing = body[5 + 8 * n : 5 + 9 * n]
        sizes = np.frombuffer(body, "<u4", n, 5 + 9 * n).tolist()
        ids = np.frombuffer(body, f"<u{width}", offset=5 + 13 * n)
        at = 0
        for key, none, size in zip(keys, missing, sizes):
            yield None if none else key, frame.start + at, ids[at : at + size]
            at += size

    def every(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for frame in self.frames:
            yield from self.documents(frame)

    def get(self, doc_ids: Iterable[int]) -> dict[int, list[np.ndarray]]:
        """Ids of the wanted documents; only frames that may hold one are decompressed."""
        wanted, found = sorted(set(doc_ids)), {}
        lows = [f.first for f in self.frames]
        for n, frame in enumerate(self.frames):
            high = lows[n + 1] if n + 1 < len(lows) else None
            if any((lows[n] is None or d >= lows[n]) and (high is None or d <= high) for d in wanted):
                for key, _, ids in self.documents(frame):
                    if key in wanted:
                        found.setdefault(key, []).append(ids)
        return found


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending ``doc_id`` order; returns the list of files.

    One file per range of ``doc_id`` (rows of one ``doc_id`` are dealt on by their text), written
    under another name and then renamed, so a repeated task replaces its own file. Null text counts
    as empty, null ``doc_id`` come first. The list has ``part``, ``path``, ``docs`` and ``ids``. The
    files hold 64-bit keys: another type of ``doc_id`` than an integer raises a ``TypeError``.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is of type {kind}; token files hold 64-bit integers as keys")
    folder = folder or f"{application_folder(spark)}/token-files-{uuid.uuid4().hex[:12]}"
    docs = plain(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, out = encoder_of(tokenizer), None, None
        store, root = open_store(folder)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}"
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in pieces(batches, 2 << 20):
            if writer is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp")
                writer = Writer(out, encoder.dtype.itemsize)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(filled(batch.column("text")))):
                writer.add(doc_id, ids.tobytes() + end)
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.tokens.zst")
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([task.partitionId()], pa.int64()),
                    "path": pa.array([f"{folder}/part-{task.partitionId():06d}.tokens.zst"]),
                    "docs": pa.array([writer.docs], pa.int64()),
                    "ids": pa.array([writer.ids], pa.int64()),
                }
            )

    spread = docs.withColumn("tie", F.xxhash64("text"))
    dealt = spread.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return cut_lineage(dealt.select("doc_id", "text").mapInArrow(run, "part bigint, path string, docs bigint, ids bigint"))


def read_files(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` from the files.

    Sums over the list of files place each file; a task reads whole files frame by frame.
    """
    # One row per file meets in one task here, never documents.
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("part", "path", before.alias("base"))
    tasks = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, name = open_store(path)
                with store.open_input_file(name) as source:
                    reader = Reader(source)
                    for frame in reader.frames:
                        rows = [(d, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in reader.documents(frame)]
                        doc_id, start, n, crc = zip(*rows)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(doc_id, pa.int64()),
                                "start": pa.array(start, pa.int64()),
                                "n_tokens": pa.array(n, pa.int64()),
                                "ids_crc32": pa.array(crc, pa.int64()),
                            }
                        )

    return placed.repartitionByRange(tasks, "part").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
