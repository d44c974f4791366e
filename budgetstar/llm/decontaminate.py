"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned by all training windows.

Windows of the benchmark are kept as hashes plus their exact words. A training text becomes a
vector of word numbers; hashes of all its windows are tested at once, hits are compared word by
word, and the covered words are marked. A benchmark beyond the broadcast bound is cut into blocks,
each within it; a task goes through all blocks for each batch of texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetstar.llm.text import pieces, plain, texts_of, words

WINDOW = 10  # words; a shorter item is one window
BLOCK_BYTES = 4 << 20  # benchmark text in one broadcast block; its index takes some ten times as much
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass
class Windows:
    """Windows of one length: sorted hashes, their word numbers, and the items of each."""

    hashes: np.ndarray
    grams: np.ndarray
    owners: list[tuple[str, ...]]


@dataclass
class Block:
    numbers: dict[bytes, int]
    windows: dict[int, Windows]


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every window of ``n`` word numbers."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
    return out


def build_block(items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> Block:
    numbers: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, text in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words(text)]
        n = min(window, len(ids))
        for at in range(len(ids) - n + 1 if n else 0):
            owners[tuple(ids[at : at + n])].add(item)
    windows = {}
    for n in {len(g) for g in owners}:
        grams = [g for g in owners if len(g) == n]
        table = np.array(grams, np.int64)
        hashes = rolling_rows(table)
        order = np.argsort(hashes, kind="stable")
        listed = [tuple(sorted(owners[grams[i]])) for i in order]
        windows[n] = Windows(hashes[order], table[order].astype(np.int32), listed)
    return Block(numbers, windows)


def rolling_rows(table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(table), np.uint64)
    for k in range(table.shape[1]):
        out = out * _BASE + table[:, k].astype(np.uint64)
    return out


def hits(block: Block, listed: list[bytes], covered: np.ndarray, items: set[str]) -> None:
    """Mark the words of a text that lie in an occurrence of a window; add the items."""
    get = block.numbers.get
    ids = np.fromiter((get(w, 0) for w in listed), np.int64, len(listed))
    unknown = np.cumsum(np.r_[0, ids == 0])
    for n, known in block.windows.items():
        if len(ids) < n:
            continue
        starts = np.flatnonzero(unknown[n:] == unknown[:-n])  # windows of benchmark words only
        if not len(starts):
            continue
        found = rolling(ids, n)[starts]
        low = np.searchsorted(known.hashes, found, "left")
        high = np.searchsorted(known.hashes, found, "right")
        for k in np.flatnonzero(high > low):
            start = starts[k]
            for row in range(low[k], high[k]):  # more than one only if hashes collide
                if np.array_equal(known.grams[row], ids[start : start + n]):
                    covered[start : start + n] = True
                    items.update(known.owners[row])


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> list[Broadcast]:
    """The benchmark as broadcast blocks of bounded size; items are dealt by a hash.

    Its size is measured first: one block holds about ``BLOCK_BYTES`` of text (or one item). A null
    text has no words; a null ``item_id`` counts as an item with an empty name.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    blocks = []
    for number in range(count):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number)
        block = build_block(((r.item, r.text.encode("utf-8", "surrogatepass")) for r in part.toLocalIterator()), window)
        blocks.append(spark.sparkContext.broadcast(cloudpickle.dumps(block)))
    return blocks


class Blocks:
    """The blocks in a task: a single one stays unpacked, of several only one is at a time."""

    def __init__(self, blocks: list[Broadcast]) -> None:
        self.blocks, self.held = blocks, (-1, None)

    def __iter__(self) -> Iterator[Block]:
        for number, block in enumerate(self.blocks):
            if self.held[0] != number:
                self.held = number, cloudpickle.loads(block.value)
            yield self.held[1]


def _marked(blocks: Blocks, texts: list[bytes]) -> list[tuple[list[bytes], np.ndarray, set[str]]]:
    marked = [(w, np.zeros(len(w), bool), set()) for w in map(words, texts)]
    for index in blocks:
        for listed, covered, items in marked:
            hits(index, listed, covered, items)
    return marked


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, hit words and items per input row; null text has no words."""
    blocks = benchmark_blocks(benchmark, window)
    docs = plain(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Blocks(blocks)
        for batch in pieces(batches):
            rows = [
                (len(w), int(c.sum()), len(i), hashlib.sha256(",".join(sorted(i)).encode()).hexdigest())
                for w, c, i in _marked(held, texts_of(batch.column("text")))
            ]
            n_words, n_hit, n_items, digest = zip(*rows)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_hit": pa.array(n_hit, pa.int64()),
                    "n_items": pa.array(n_items, pa.int64()),
                    "items_sha256": pa.array(digest, pa.string()),
                    "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The rows without any occurrence of a benchmark window, with all their columns."""
    blocks = benchmark_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Blocks(blocks)
        for batch in pieces(batches):
            clean = [not c.any() for _, c, _ in _marked(held, texts_of(batch.column(text)))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """All rows and columns; each run of hit words is taken out of the text, from its first to its last word."""
    blocks = benchmark_blocks(benchmark, window)

    def cut(raw: bytes, covered: np.ndarray) -> bytes:
        at, kept, edge = [m.span() for m in _WORD_BYTES.finditer(raw)], [], 0
        border = np.flatnonzero(np.diff(np.r_[False, covered, False]))
        for first, end in zip(border[::2], border[1::2]):
            kept.append(raw[edge : at[first][0]])
            edge = at[end - 1][1]
        return b"".join([*kept, raw[edge:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Blocks(blocks)
        for batch in pieces(batches):
            column = batch.column(text)
            raw = texts_of(column)
            new = [
                None if missing else cut(t, c).decode("utf-8", "surrogatepass") if c.any() else t.decode("utf-8", "surrogatepass")
                for t, (_, c, _), missing in zip(raw, _marked(held, raw), column.is_null().to_pylist())
            ]
            yield batch.set_column(batch.schema.get_field_index(text), batch.schema.field(text), pa.array(new, column.type))

    return docs.mapInArrow(run, docs.schema)
