"""Hard negatives by threshold joins over an inverted index that leaves covered dimensions out.

Rows and anchors meet in blocks. The dimensions are ordered by their energy in the whole table. In a
block only those are indexed that the norms behind them do not cover: what is left out could not
lift a pair to the threshold on its own. Partial scores of the indexed dimensions are accumulated,
pairs whose remaining norms cannot make up the difference are dropped, the rest are completed
exactly. Thresholds start high and are lowered, for anchors whose windows are not full yet, down to
the floor of the window; what is found above a threshold is complete, so a full window is final.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetstar.sources.shared import cut_lineage

SCALE = 256
ROW_BLOCK, ANCHOR_BLOCK = 1 << 12, 1 << 9  # rows and anchors whose products are held at once
LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 16  # of a unit of work: tables are cut into 16 units a side within these bounds
LEAST_ANCHORS, MOST_ANCHORS = 1 << 9, 1 << 13
LEVELS = (85, 70)  # hundredths of the positive's score where the threshold of a window starts; its floor comes last
STEP = 8  # dimensions between two looks at the remaining norms
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Rule:
    """Which rows are anchors, how many positives and negatives they get, and the window in hundredths."""

    every: int = 50
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


# --- threshold join of two blocks ----------------------------------------------------------------


class Block:
    """Vectors with their dimensions in the order of the index, and the norms of what is behind each."""

    def __init__(self, values: np.ndarray, order: np.ndarray) -> None:
        self.values = np.ascontiguousarray(values[:, order])
        squares = np.square(self.values, dtype=np.float64)
        behind = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
        # [:, d]: norm of the dimensions from d on, rounded up so that it bounds whatever the rounding.
        self.norms = np.sqrt(np.c_[behind, np.zeros(len(values))]) * (1 + 1e-6)


def exact_type(a: Block, b: Block) -> type:
    """A number type in which all partial sums are whole: they are bounded by the product of the norms."""
    most = a.norms[:, 0].max(initial=0) * b.norms[:, 0].max(initial=0)
    if most >= 1 << 62:
        raise OverflowError("Inner products do not fit 64 bits")
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 52 else np.int64


def threshold_join(anchors: Block, least: np.ndarray, rows: Block, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and inner product of the allowed pairs whose product reaches the anchor's threshold."""
    dims = anchors.values.shape[1]
    kind = exact_type(anchors, rows)
    rough = np.float32 if kind is np.float32 else np.float64
    wanted = np.maximum(least, np.iinfo(np.int64).min // 4) - 0.5  # products are whole numbers
    # Index: the dimensions that the norms behind them cover for every anchor are left out.
    reach = anchors.norms * rows.norms.max(axis=0, initial=0.0)
    open_dims = np.flatnonzero((reach[:, :dims] >= wanted[:, None]).any(axis=0))
    indexed = int(open_dims[-1]) + 1 if len(open_dims) else 0
    if not indexed:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    partial = anchors.values[:, :indexed].astype(kind) @ rows.values[:, :indexed].astype(kind).T
    rest = np.multiply.outer(anchors.norms[:, indexed].astype(rough), rows.norms[:, indexed].astype(rough))
    a, r = np.nonzero((partial + rest >= wanted[:, None].astype(rough)) & allowed)
    score = partial[a, r].astype(np.int64)
    for d in range(indexed, dims, STEP):
        near = score + anchors.norms[a, d] * rows.norms[r, d] >= wanted[a]
        a, r, score = a[near], r[near], score[near]
        score = score + np.einsum("ij,ij->i", anchors.values[a, d : d + STEP], rows.values[r, d : d + STEP])
    met = score >= least[a]
    return a[met], r[met], score[met]


def first_per_group(group: np.ndarray, score: np.ndarray, key: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first ``most`` of each group, by score, highest first, then by key."""
    order = np.lexsort((key, -score, group))
    sorted_group = group[order]
    new = np.r_[True, sorted_group[1:] != sorted_group[:-1]] if len(order) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.empty(0, np.int64)
    return order[np.arange(len(order)) - start < most]


# --- blocks in Spark -----------------------------------------------------------------------------


def prepare(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows that take part, numbered: ``row``, ``key``, ``label`` (after the shift) and whole ``values``.

    Rows with a null label or vector, or with a null or non-finite component, take no part; a null
    key comes last among ties and is never an anchor.
    """
    listed = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(listed, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col(f"`{label}`").isNotNull() & listed.isNotNull() & F.coalesce(finite, F.lit(False)))
    named = usable.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{label}`").cast("bigint").alias("label"), listed.alias("x"))
    moved = F.when(F.col("key") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    values = F.transform("x", lambda x: F.floor(x * F.lit(float(SCALE))).cast("bigint"))
    return cut_lineage(
        named.select(F.monotonically_increasing_id().alias("row"), F.coalesce("key", F.lit(_LAST)).alias("key"), moved.alias("label"), values.alias("values"))
    )


@dataclass(frozen=True)
class Shape:
    """What is known of the table: rows, labels, dimensions in the order of the index, their means and energies."""

    rows: int
    labels: int
    order: np.ndarray
    means: np.ndarray
    energies: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.order)


def shape_of(rows: DataFrame) -> Shape:
    known = rows.agg(F.max(F.size("values")).alias("dims"), F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    dims = known.dims or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(dims), np.zeros(dims)
        for batch in batches:
            values = matrix(batch.column("values"), dims).astype(np.float64)
            total, squares = total + values.sum(axis=0), squares + np.square(values).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(dims)), "total": pa.array(total), "squares": pa.array(squares)})

    # One row per dimension reaches the driver.
    sums = rows.select("values").mapInArrow(run, "dim bigint, total double, squares double").groupBy("dim")
    means, energies = np.zeros(dims), np.zeros(dims)
    for r in sums.agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")).toLocalIterator():
        means[r.dim], energies[r.dim] = r.total / max(1, known.n), r.squares / max(1, known.n)
    return Shape(known.n, known.labels, np.argsort(-energies, kind="stable"), means, energies)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of a matrix; missing dimensions count as 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def units(n: int, least: int, most: int) -> int:
    return max(1, -(-n // min(most, max(least, n // 16))))


def meet(rows: DataFrame, anchors: DataFrame, n: tuple[int, int], work, schema: str) -> DataFrame:
    """``work`` on each part of the rows with each part of the anchors: the stated anchors against all rows, in blocks.

    Both sides are dealt to a grid of units by their row numbers, so no label or vector weighs on one
    task, and a unit has a bounded size.
    """
    down, across = units(n[0], LEAST_ROWS, MOST_ROWS), units(n[1], LEAST_ANCHORS, MOST_ANCHORS)

    def part(side: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(side)).cast("int")

    left = rows.withColumn("g", part(down)).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = anchors.withColumn("h", part(across)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(work, schema)


def _blocks(table: pa.Table, shape: Shape, most: int) -> Iterator[tuple[pa.Table, Block]]:
    for at in range(0, table.num_rows, most):
        part = table.slice(at, most).combine_chunks()
        yield part, Block(matrix(part.column("values").chunk(0), shape.dims), shape.order)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _pairs(rows: pa.Table, anchors: pa.Table, shape: Shape, same: bool):
    """For each pair of blocks: the anchors, and anchor, row number, key and score of the pairs found."""
    held = list(_blocks(anchors, shape, ANCHOR_BLOCK))
    for part, block in _blocks(rows, shape, ROW_BLOCK):
        number, key, label = (_column(part, c) for c in ("row", "key", "label"))
        for asked, vectors in held:
            equal = np.equal.outer(_column(asked, "label"), label)
            a, r, score = threshold_join(vectors, _column(asked, "least"), block, equal if same else ~equal)
            yield asked, a, number[r], key[r], score


def _found(anchor: list, slot: list, score: list, key: list) -> pa.Table:
    flat = [np.concatenate([np.empty(0, np.int64), *x]) for x in (anchor, slot, score, key)]
    return pa.table({n: pa.array(v) for n, v in zip(("anchor", "slot", "score", "key"), flat)})


_FOUND = "anchor bigint, slot bigint, score bigint, key bigint"


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each anchor and slot, with their ``rank``."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _is_empty(table: DataFrame) -> bool:
    return table.limit(1).count() == 0


def find_positives(rows: DataFrame, anchors: DataFrame, shape: Shape, n_anchors: int, rule: Rule) -> DataFrame:
    """``anchor`` (row number), ``slot``, ``key`` and ``score`` of the first rows of the anchor's label.

    The first threshold is where a normal law of the scores would leave a few rows of a label; anchors
    that find too few above it go on with half the distance to the mean, then without a threshold.
    """
    tail = 3 * rule.positives * max(1, shape.labels) / max(1, shape.rows)
    distance = NormalDist().inv_cdf(1 - tail) if tail < 0.3 else None
    means, spread = shape.means, np.maximum(shape.energies - shape.means**2, 0)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], [], []
        for asked, a, number, key, score in _pairs(left, right, shape, True):
            own = _column(asked, "row")
            other = number != own[a]
            a, key, score = a[other], key[other], score[other]
            best = first_per_group(a, score, key, rule.positives)
            for x, v in zip(out, (own[a[best]], np.zeros(len(best), np.int64), score[best], key[best])):
                x.append(v)
        return _found(*out)

    def estimated(share: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = matrix(batch.column("values"), shape.dims).astype(np.float64)
                least = values @ means + share * distance * np.sqrt(np.square(values) @ spread)
                yield batch.append_column("least", pa.array(np.floor(least).astype(np.int64)))

        return run

    open_, parts = anchors, []
    for share in (1.0, 0.5, None) if distance else (None,):
        if share is None:
            asked = open_.withColumn("least", F.lit(np.iinfo(np.int64).min))
        else:
            asked = open_.mapInArrow(estimated(share), "row bigint, key bigint, label bigint, values array<bigint>, least bigint")
        found = cut_lineage(_first(meet(rows, asked, (shape.rows, n_anchors), work, _FOUND), rule.positives))
        if share is None:
            parts.append(found)
            break
        full = found.where(F.col("rank") == rule.positives).select("anchor")
        parts.append(found.join(full, "anchor", "left_semi"))
        open_ = cut_lineage(open_.join(full, open_["row"] == full["anchor"], "left_anti"))
        if _is_empty(open_):
            break
    return _union(parts).select("anchor", F.col("rank").cast("bigint").alias("slot"), "key", "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def find_negatives(rows: DataFrame, anchors: DataFrame, positives: DataFrame, shape: Shape, n_anchors: int, rule: Rule) -> DataFrame:
    """``anchor``, ``slot``, ``rank``, ``key`` and ``score`` of the first rows in each window.

    All rows above a threshold are found, so a window that is full is done. The others go on with a
    lower threshold, at last with the floor of the window.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], [], []
        for asked, a, _, key, score in _pairs(left, right, shape, False):
            own, windows = _column(asked, "row"), asked.column("windows").combine_chunks()
            ends, flat = windows.offsets.to_numpy(), windows.flatten()
            slots, low, high = (flat.field(f).to_numpy() for f in ("slot", "low", "high"))
            for number in range(rule.positives):  # the number-th open window of each anchor
                at = np.minimum(ends[:-1] + number, max(0, len(slots) - 1) + ends[0])[a] - ends[0]
                inside = (ends[:-1] + number < ends[1:])[a] & (score >= low[at]) & (score <= high[at])
                x, k, s, w = a[inside], key[inside], score[inside], slots[at[inside]]
                best = first_per_group(x, s, k, rule.negatives)
                for held, v in zip(out, (own[x[best]], w[best], s[best], k[best])):
                    held.append(v)
        return _found(*out)

    levels = [*(level for level in LEVELS if level > rule.low), rule.low]
    high = F.floor(F.expr(f"{rule.high} * score div 100"))
    open_, parts = positives.where("score >= 0").select("anchor", "slot", "score", high.alias("high")), []
    for level in levels:
        low = F.expr(f"({level} * score + 99) div 100").alias("low")
        listed = open_.select("anchor", "slot", low, "high").where("low <= high")
        listed = listed.groupBy("anchor").agg(
            F.min("low").alias("least"), F.array_sort(F.collect_list(F.struct("slot", "low", "high"))).alias("windows")
        )
        asked = anchors.join(listed, anchors["row"] == listed["anchor"]).select("row", "key", "label", "values", "least", "windows")
        found = cut_lineage(_first(meet(rows, asked, (shape.rows, n_anchors), work, _FOUND), rule.negatives))
        if level == levels[-1]:
            parts.append(found)
            break
        full = found.where(F.col("rank") == rule.negatives).select("anchor", "slot")
        parts.append(found.join(full, ["anchor", "slot"], "left_semi"))
        open_ = cut_lineage(open_.join(full, ["anchor", "slot"], "left_anti"))
        if _is_empty(open_):
            break
    return _union(parts)


def mine(vectors: DataFrame, rule: Rule = Rule(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per anchor, positive and negative: ids, ``rank`` and both scores, whole numbers.

    Anchors are rows whose key is divisible by ``rule.every``. Every row counts, also repeated ones: a
    second row of the anchor's key is another row. Vectors of different lengths meet as if the shorter
    ones went on with zeros. Inner products beyond 62 bits raise an ``OverflowError``.
    """
    rows = prepare(vectors, key, vector, label)
    anchors = cut_lineage(rows.where((F.col("key") % rule.every == 0) & (F.col("key") != _LAST)))
    shape, n_anchors = shape_of(rows), anchors.count()
    positives = cut_lineage(find_positives(rows, anchors, shape, n_anchors, rule))
    negatives = find_negatives(rows, anchors, positives, shape, n_anchors, rule)
    named = positives.select("anchor", "slot", _id("key").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.select("anchor", "slot", F.col("rank").cast("int").alias("rank"), _id("key").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
    joined = found.join(named, ["anchor", "slot"]).join(ids, "anchor")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _id(key: str) -> Column:
    return F.when(F.col(key) != _LAST, F.col(key))
