"""Ranked lexical search, term at a time with a limited set of accumulators.

One scan turns documents into a compact index: for each document the query terms it holds and how
often. Each task of the second scan goes through its documents in slices. Terms of a query come
rarest first; a posting opens an accumulator only while all terms still to come could lift a new
document to the kth best score known. From then on terms update the survivors alone, exactly.
The kth best score starts from a sample of the index, where it is a lower bound of the true one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from budgetstar.llm.text import pieces, plain, texts_of, words
from budgetstar.sources.shared import cut_lineage

TOP = 50
BLOCK_BYTES = 4 << 20  # query text in one block: bounds what is broadcast
SLICE = 1 << 14  # documents that are searched together
SAMPLE = 1 << 14  # documents, about, whose scores give the first thresholds
SPREAD = 64  # parts of a query's candidates that are cut to the best before the last choice
# The weights of the score.
SCALE, SATURATION, LENGTH, FLOOR, SLOPE = 1_000_000_000, 1000, 20, 50, 50
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms with repeats."""

    documents: int
    terms: int

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        """The length norm m of documents."""
        if self.terms == 0:
            return np.full(len(lengths), FLOOR, np.int64)
        if SLOPE * int(lengths.max(initial=0)) * self.documents > 1 << 62:
            return np.array([FLOOR + SLOPE * n * self.documents // self.terms for n in lengths.tolist()], np.int64)
        return FLOOR + SLOPE * lengths * self.documents // self.terms

    def weight(self, frequency: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * frequency + 1)))


def impacts(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What one occurrence weight is multiplied with: saturated term frequencies."""
    return SCALE * counts // (SATURATION * counts + LENGTH * norms)


def first_of(scores: np.ndarray, keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` pairs by score, highest first, then by key."""
    order = np.lexsort((keys, -scores))[:top]
    return scores[order], keys[order]


class Slice:
    """Postings of some documents, by term."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, corpus: Corpus) -> None:
        order = np.argsort(terms, kind="stable")
        self.keys, self.size = keys, len(keys)
        self.docs = owner[order]
        self.values = impacts(counts[order].astype(np.int64), corpus.norms(lengths)[self.docs])
        known, first = np.unique(terms[order], return_index=True)
        ends = np.r_[first[1:], len(order)].astype(np.int64)
        highest = np.maximum.reduceat(self.values, first) if len(first) else np.empty(0, np.int64)
        self.postings = {t: (a, b, h) for t, a, b, h in zip(known.tolist(), first.tolist(), ends.tolist(), highest.tolist())}
        self.scores = np.zeros(self.size, np.int64)
        self.open = np.zeros(self.size, bool)

    def search(self, terms: list[tuple[int, int]], top: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and documents that may be among the best; ``terms`` are (term, weight), rarest first.

        ``threshold`` is a score that ``top`` documents reach anywhere, or 0.
        """
        here = [(*self.postings[t], w) for t, w in terms if t in self.postings and w > 0]
        rest = np.cumsum([0, *[h * w for _, _, h, w in reversed(here)]])[::-1].tolist()  # bound of the terms from here on
        scores, open_ = self.scores, self.open
        alive = np.empty(0, np.int64)
        growing = True
        for at, (a, b, _, weight) in enumerate(here):
            docs, values = self.docs[a:b], self.values[a:b]
            if growing and len(alive) >= top and at:
                partial = scores[alive]
                threshold = max(threshold, int(np.partition(partial, len(partial) - top)[len(partial) - top]))
            if growing and rest[at] < threshold:
                growing = False
            if growing:
                new = docs[~open_[docs]]
                open_[new] = True
                scores[docs] += values * weight
                alive = np.concatenate([alive, new])
                continue
            stays = scores[alive] + rest[at] >= threshold
            if not stays.all():
                gone = alive[~stays]
                open_[gone], scores[gone] = False, 0
                alive = alive[stays]
            if len(alive) * 16 < b - a:  # few survivors look themselves up in a long list
                alive.sort()
                spot = np.minimum(np.searchsorted(docs, alive), b - a - 1)
                met = docs[spot] == alive
                scores[alive[met]] += values[spot[met]] * weight
            else:
                met = open_[docs]
                scores[docs[met]] += values[met] * weight
        found = scores[alive]
        open_[alive], scores[alive] = False, 0
        keep = found >= max(1, threshold)
        return first_of(found[keep], self.keys[alive[keep]], top)


def _vocabulary(items: DataFrame) -> tuple[list[bytes], list[list[int]]]:
    """Distinct terms of a block of queries, and the terms of each query."""
    numbers: dict[bytes, int] = {}
    asked = []
    for row in items.select("number", "text").orderBy("number").toLocalIterator():
        text = (row.text or "").encode("utf-8", "surrogatepass")
        asked.append((row.number, [numbers.setdefault(w, len(numbers)) for w in dict.fromkeys(words(text))]))
    return list(numbers), asked


def _index(vocabulary):
    """Query terms and their counts of every document, sorted by term; ``n`` counts all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {w: i for i, w in enumerate(vocabulary.value)}
        get, size = numbers.get, max(1, len(numbers))
        for batch in pieces(batches):
            listed = [words(t) for t in texts_of(batch.column("text"))]
            lengths = np.fromiter(map(len, listed), np.int64, len(listed))
            owner = np.repeat(np.arange(len(listed)), lengths)
            ids = np.fromiter((get(w, -1) for ws in listed for w in ws), np.int64, len(owner))
            kept = ids >= 0
            pair, counts = np.unique(owner[kept] * size + ids[kept], return_counts=True)
            borders = np.searchsorted(pair, np.arange(len(listed) + 1) * size).tolist()
            terms, counts = (pair % size).astype(np.int32), counts.astype(np.int32)
            spans = list(zip(borders[:-1], borders[1:]))
            yield pa.RecordBatch.from_pydict(
                {
                    "key": batch.column("doc_id"),
                    "n": pa.array(lengths),
                    "terms": pa.array([terms[a:b].tobytes() for a, b in spans], pa.binary()),
                    "counts": pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
                }
            )

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, one row per term and batch."""
    for batch in batches:
        terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
        known, times = np.unique(terms, return_counts=True)
        yield pa.RecordBatch.from_pydict({"term": pa.array(known.astype(np.int32)), "documents": pa.array(times.astype(np.int64))})


def _slices(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[Slice]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= SLICE:
            yield _slice(held, corpus)
            held, n = [], 0
    if n:
        yield _slice(held, corpus)


def _slice(batches: list[pa.RecordBatch], corpus: Corpus) -> Slice:
    table = pa.Table.from_batches(batches)
    parts = table.column("terms").to_pylist()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return Slice(
        table.column("key").to_numpy(),
        table.column("n").to_numpy(),
        np.repeat(np.arange(len(parts)), sizes),
        np.frombuffer(b"".join(parts), np.int32),
        np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32),
        corpus,
    )


def _searched(queries, thresholds: dict[int, int], corpus: Corpus, top: int):
    """The best documents of a task for each query; the kth best score carries over from slice to slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in _slices(batches, corpus):
            for number, terms in queries.value:
                scores, keys = best.get(number, (none, none))
                least = thresholds.get(number, 0)
                if len(scores) == top:
                    least = max(least, int(scores[-1]))
                found, docs = part.search(terms, top, least)
                if len(found):
                    best[number] = first_of(np.concatenate([scores, found]), np.concatenate([keys, docs]), top)
        for number, (scores, keys) in best.items():
            yield pa.RecordBatch.from_pydict(
                {"number": pa.array(np.full(len(keys), number)), "key": pa.array(keys), "score": pa.array(scores)}
            )

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of each query with their ``rank``; first within parts, so no task meets all candidates of a query."""
    order = [F.desc("score"), F.asc("key")]
    part = found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SPREAD)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("number", "part").orderBy(*order))).where(F.col("rank") <= top)
    whole = part.drop("part", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order)))
    return whole.where(F.col("rank") <= top)


def _search_block(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """``number``, ``key``, ``score`` and ``rank`` for the queries of one block."""
    spark = docs.sparkSession
    terms, asked = _vocabulary(items)
    vocabulary = spark.sparkContext.broadcast(terms)
    index = cut_lineage(docs.mapInArrow(_index(vocabulary), "key bigint, n bigint, terms binary, counts binary"))
    total = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms"), F.count("*").alias("rows")).first()
    corpus = Corpus(total.documents, total.terms or 0)
    # As many numbers as a block of queries has terms.
    held = index.select("terms").mapInArrow(_held, "term int, documents bigint").groupBy("term").agg(F.sum("documents").alias("n"))
    frequency = {r.term: r.n for r in held.toLocalIterator()}
    weighed = [
        (number, [(t, corpus.weight(frequency[t])) for t in sorted((t for t in listed if t in frequency), key=lambda t: (frequency[t], t))])
        for number, listed in asked
    ]
    queries = spark.sparkContext.broadcast(weighed)
    result = "number bigint, key bigint, score bigint"
    share = min(1.0, SAMPLE / max(1, total.rows))
    chance = F.xxhash64("key", "n", "terms").bitwiseAND(F.lit((1 << 32) - 1)) < F.lit(int(share * (1 << 32)))
    first = _ranked(index.where(chance).mapInArrow(_searched(queries, {}, corpus, top), result), top)
    thresholds = {r.number: r.score for r in first.where(F.col("rank") == top).toLocalIterator()}
    return _ranked(index.mapInArrow(_searched(queries, thresholds, corpus, top), result), top)


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``top`` best documents of every query: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Every row of ``items`` is a query, every row of ``docs`` a document, repeated rows too. Null
    texts and texts without terms match nothing; equal scores are ranked by ``doc_id``, null last (so
    the largest 64-bit number is no ``doc_id`` of its own). ``doc_id`` has to be an integer. Queries
    are searched in blocks of at most about ``BLOCK_BYTES`` of text, one scan of the documents each.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is of type {kind}; ranks among equal scores need an integer")
    listed = items.select(
        F.col(f"`{item}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"), F.monotonically_increasing_id().alias("number")
    )
    listed = cut_lineage(listed)
    size = listed.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    lean = plain(docs, key, text).select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc_id"), "text")
    found = [
        _search_block(lean, listed.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b), top) for b in range(blocks)
    ]
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.unionByName(more)
    doc_id = F.when(F.col("key") != _LAST, F.col("key")).cast(kind).alias("doc_id")
    return ranked.join(listed.select("number", "item_id"), "number").select("item_id", "rank", doc_id, "score")
