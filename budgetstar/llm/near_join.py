"""N-gram Jaccard join: MinHash bands propose pairs, full n-gram sets decide.

Texts with the same n-gram set are collapsed first, so copies never multiply pairs. Band and row
numbers follow from the wanted recall. A bucket is cut into blocks and each pair of blocks is one
unit of work, so no task holds more than two blocks, whatever the bucket. A pair that meets in
several bands belongs to the lowest of them. Units give sums and local roots per text, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetstar.llm.components import components
from budgetstar.llm.located import Notes, flag, flagged, located, text_bytes, without
from budgetstar.llm.text import kept_by_worker, pieces, plain, texts_of, unused, words
from budgetstar.sources.shared import cut_lineage

GRAM = 5  # words
SIMILARITY = 0.8
RECALL = 0.9999  # of a pair at exactly the wanted similarity; more similar pairs are surer
ROWS = 5
BLOCK = 512  # texts of a bucket in one block
KNOWN_WORDS = 250_000  # hashes of words a worker remembers
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def band_count(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands needed so that a pair of that similarity meets in one of them with that probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def gram_sets(texts: list[bytes], known: WordHashes, gram: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a shorter text is one n-gram."""
    listed = [words(t) for t in texts]
    sizes = [len(w) for w in listed]
    flat = np.fromiter((known[w] for ws in listed for w in ws), np.uint64, sum(sizes))
    windows = max(0, len(flat) - gram + 1)
    rolled = np.zeros(windows, np.uint64)
    for k in range(gram):
        rolled = rolled * _BASE + flat[k : k + windows]
    rolled, sets, at = scramble(rolled), [], 0
    for n in sizes:
        if n >= gram:
            sets.append(np.unique(rolled[at : at + n - gram + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for h in flat[at : at + n]:
                whole = whole * _BASE + h
            sets.append(scramble(whole))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    high = np.array([scramble(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    low = np.array([scramble(s ^ _BASE).sum(dtype=np.uint64) for s in sets], np.uint64)
    return high, low


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    seeds = scramble(np.arange(1, bands * rows + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    out = np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        joined = np.full(len(sets), band + 1, np.uint64)
        for row in range(rows):
            least = np.minimum.reduceat(flat * seeds[band * rows + row], starts)
            joined = scramble(joined * _BASE + least)
        out[:, band] = joined
    return out


def _signatures(gram: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker("word hashes", WordHashes)
        for batch in pieces(batches, 1 << 20):
            sets = gram_sets(texts_of(batch.column("text")), known, gram)
            sizes = np.array([len(s) for s in sets], np.int64)
            high, low = set_keys(sets)
            full = [s for s in sets if len(s)]
            hashes = band_hashes(full, bands, rows) if full else np.zeros((0, bands), np.uint64)
            offsets = np.r_[0, np.cumsum((sizes > 0) * bands)].astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "file": batch.column("file"),
                    "place": batch.column("place"),
                    "high": pa.array(high.view(np.int64)),
                    "low": pa.array(low.view(np.int64)),
                    "size": pa.array(sizes),
                    "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.ravel().view(np.int64))),
                }
            )

    return run


def _sets(gram: int, notes: Notes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker("word hashes", WordHashes)
        for batch in pieces(flagged(batches, notes), 1 << 20):
            sets = gram_sets(texts_of(batch.column("text")), known, gram)
            high, low = set_keys(sets)
            yield pa.RecordBatch.from_pydict(
                {
                    "high": pa.array(high.view(np.int64)),
                    "low": pa.array(low.view(np.int64)),
                    "grams": pa.array([s.tobytes() for s in sets], pa.binary()),
                }
            )

    return run


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one unit (bucket, left, right) at a time from a stream sorted by unit."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "left", "right")]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            unit = tuple(k[a] for k in keys)
            if last is not None and unit != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = unit
    if held:
        yield pa.Table.from_batches(held)


def owned_pairs(unit: pa.Table) -> np.ndarray:
    """Matrix of the pairs that belong to this unit: across its blocks, and in no lower band together."""
    rows = unit.num_rows
    band, block = unit.column("band")[0].as_py(), unit.column("block").to_numpy()
    left, right = unit.column("left")[0].as_py(), unit.column("right")[0].as_py()
    lists = unit.column("bands").combine_chunks()
    bands = lists.flatten().to_numpy().reshape(rows, -1)
    node = unit.column("node").to_numpy()
    pairs = node[:, None] < node[None, :]
    if left != right:
        pairs &= block[:, None] != block[None, :]
    for lower in range(band):
        column = bands[:, lower]
        pairs &= column[:, None] != column[None, :]
    return pairs


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a unit that own a pair in it."""
    for unit in units(batches):
        pairs = owned_pairs(unit)
        wanted = pairs.any(axis=0) | pairs.any(axis=1)
        if wanted.any():
            kept = unit.select(["bucket", "left", "right", "band", "block", "node"]).filter(pa.array(wanted))
            yield from kept.combine_chunks().to_batches()


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common elements of the pairs (left[i], right[i])."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # n-grams of a single set are in no intersection
    shared = times[column] > 1
    member, column = member[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (first, first + width))
        part = np.zeros((len(sets), width), np.float32)
        part[member[a:b], column[a:b] - first] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def local_roots(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node each node is connected with by the pairs."""
    root = np.arange(len(nodes))
    order = np.argsort(nodes)
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    label = rank.copy()
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[order][after]  # follow the label of the label
        if np.array_equal(after, label):
            break
        label = after
    del root
    return nodes[order[label]]


def _verified(similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            left, right = np.nonzero(owned_pairs(unit))
            if not len(left):
                continue
            sets = [np.frombuffer(g, np.uint64) for g in unit.column("grams").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            common = intersections(sets, left, right)
            near = common >= similarity * (sizes[left] + sizes[right] - common) - 1e-9
            left, right = left[near], right[near]
            if not len(left):
                continue
            nodes, copies = unit.column("node").to_numpy(), unit.column("copies").to_numpy()
            links = np.bincount(left, copies[right], len(nodes)) + np.bincount(right, copies[left], len(nodes))
            found = np.flatnonzero(links)
            yield pa.RecordBatch.from_pydict(
                {
                    "node": pa.array(nodes[found]),
                    "root": pa.array(local_roots(nodes, left, right)[found]),
                    "links": pa.array(links[found].astype(np.int64)),
                }
            )

    return run


def _by_unit(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")


def classes(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    gram: int = GRAM,
    rows: int = ROWS,
    recall: float = RECALL,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id``, place, ``group``, ``class_id``, ``n_links``.

    ``n_links`` counts the other rows whose n-gram set is at least that similar, copies included;
    ``class_id`` is the largest ``doc_id`` among all rows connected by links, ``group`` a number of
    that class (null without links). Null text counts as empty; a text without words links to nothing.
    """
    return _classes(located(plain(docs, key, text)), similarity, gram, rows, recall)


def _classes(docs: DataFrame, similarity: float = SIMILARITY, gram: int = GRAM, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    if not 0 < similarity <= 1:
        raise ValueError("similarity has to lie in (0, 1]")
    bands = band_count(similarity, rows, recall) if similarity < 1 else 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = cut_lineage(
        docs.mapInArrow(
            _signatures(gram, bands, rows),
            f"doc_id {kind}, file bigint, place bigint, high bigint, low bigint, size bigint, bands array<bigint>",
        )
    )
    texts = (
        signed.where("size > 0")
        .groupBy("high", "low")
        .agg(
            F.max("doc_id").alias("rep"),
            F.count("*").alias("copies"),
            F.first("bands").alias("bands"),
            F.min(F.struct("file", "place")).alias("at"),
        )
    )
    texts = cut_lineage(texts.withColumn("node", F.monotonically_increasing_id()))
    found = _links(docs, texts, similarity, gram)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    roots = components(linked)

    every = texts.select("node", "high", "low", "rep", "copies").join(links, "node", "left").join(roots, "node", "left")
    every = cut_lineage(every.withColumn("root", F.coalesce("root", "node")))
    names = every.groupBy("root").agg(F.max("rep").alias("class_id"))
    named = every.join(names, "root").select(
        "high", "low", F.col("root").alias("group"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = signed.select("doc_id", "file", "place", "high", "low", "size").join(named, ["high", "low"], "left")
    alone = (F.col("size") == 0) | (F.coalesce("n_links", F.lit(0)) == 0)
    return out.select(
        "doc_id",
        "file",
        "place",
        F.when(~alone, F.col("group")).alias("group"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
    )


def _links(docs: DataFrame, texts: DataFrame, similarity: float, gram: int) -> DataFrame:
    """``node``, a ``root`` it is connected with and ``links``, per unit of work that found any."""
    listed = texts.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = listed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK)
    met = listed.join(shared, "bucket").select(
        "node", "band", "bucket", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block")
    )
    dealt = met.select("node", "band", "bucket", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "node", "band", "bucket", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")
    )
    light = dealt.join(texts.select("node", "bands"), "node")
    needed = cut_lineage(
        _by_unit(light).mapInArrow(
            _needed, "bucket bigint, left bigint, right bigint, band int, block bigint, node bigint"
        )
    )
    # One text of each candidate is read again, where it lies.
    wanted = cut_lineage(needed.select("node").distinct().join(texts, "node"))
    notes = flag(wanted.select("at.file", "at.place"), text_bytes(docs))
    sets = docs.select("text", "file", "place").mapInArrow(_sets(gram, notes), "high bigint, low bigint, grams binary")
    held = sets.join(wanted, ["high", "low"]).groupBy("node").agg(
        F.first("grams").alias("grams"), F.first("bands").alias("bands"), F.first("copies").alias("copies")
    )
    full = needed.join(cut_lineage(held), "node")
    return cut_lineage(_by_unit(full).mapInArrow(_verified(similarity), "node bigint, root bigint, links bigint"))


def report(docs: DataFrame, **options) -> DataFrame:
    return classes(docs, **options).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, the one with the largest ``doc_id``, with all its columns.

    The places of all rows that go are noted; the rows are read again and none of them moves.
    """
    file, place = unused(docs.columns, "file"), unused(docs.columns, "place")
    placed = located(docs, file, place)
    lean = placed.select(
        F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(file).alias("file"), F.col(place).alias("place")
    )
    found = cut_lineage(_classes(lean, **options).where("n_links > 0").select("doc_id", "file", "place", "group", "class_id"))
    at = F.struct("file", "place")
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("group").agg(F.min(at).alias("stays"))
    gone = found.select("group", "file", "place").join(stays, "group").where(at != F.col("stays"))
    return without(placed, flag(gone, text_bytes(lean)), docs.columns, file, place)
