"""Vector best-fit packing of documents into training sequences.

A sequence has three capacities: tokens, documents and attention cost (sum of squared lengths).
Pieces go, largest first, into the open sequence that fits under every capacity and is best by a
weighted rule: the largest dot product of need and residual, or the smallest norm of what would
remain. Lots of bounded size are packed apart, so the work of a task does not grow with the corpus.
Pieces of sequences that a lot leaves partly filled meet those of other lots in further rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetstar.llm.encoding import encoder as encoder_of
from budgetstar.llm.encoding import filled
from budgetstar.llm.text import pieces, plain
from budgetstar.sources.shared import cut_lineage

LOT = 8192  # pieces that are packed together
FULL = 0.998  # share of a capacity from which a sequence is not opened again


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and the weights of the rule, in the order tokens, documents, cost.

    The defaults let only tokens bind: n tokens are at most n documents and cost at most n squared.
    """

    tokens: int = 4096
    documents: int = 4096
    cost: int = 4096**2
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"  # or "dot"

    def __post_init__(self) -> None:
        if self.rule not in ("norm", "dot") or min(self.tokens, self.documents, self.cost) < 1:
            raise ValueError("rule is norm or dot, and all capacities are at least 1")
        if self.piece < 1:
            raise ValueError("No piece fits the capacities")

    @property
    def piece(self) -> int:
        """The longest piece that fits an empty sequence."""
        return min(self.tokens, int(self.cost**0.5))


def assign(lengths: np.ndarray, limits: Limits) -> np.ndarray:
    """The sequence of each piece, numbered from 0."""
    capacity = np.array([limits.tokens, limits.documents, limits.cost], float)
    weights, n = np.array(limits.weights), len(lengths)
    out = np.empty(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = lengths[order[-1]] if n else 0
    rest = np.empty((3, max(16, n)))  # residuals of open sequences as shares of the capacity
    names = np.empty(max(16, n), np.int64)
    opened = made = 0
    least = np.array([smallest, 1, smallest**2]) / capacity
    slack = 1e-12
    for i in order:
        length = int(lengths[i])
        need = np.array([length, 1, length * length]) / capacity
        best = -1
        if opened:
            left = rest[:, :opened] - need[:, None]
            fits = (left >= -slack).all(axis=0)
            if limits.rule == "dot":
                value = np.where(fits, (weights * need) @ rest[:, :opened], -1.0)
                best = int(value.argmax())
            else:
                value = np.where(fits, weights @ (left * left), np.inf)
                best = int(value.argmin())
            if not fits[best]:
                best = -1
        if best < 0:
            best, names[opened] = opened, made
            rest[:, opened] = 1.0
            opened, made = opened + 1, made + 1
        rest[:, best] -= need
        out[i] = names[best]
        if (rest[:, best] < least - slack).any():  # nothing fits any more: close it
            opened -= 1
            rest[:, best], names[best] = rest[:, opened], names[opened]
    return out


def cut(docs: DataFrame, tokenizer: str, end_id: int, longest: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every text: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``; null text counts as empty."""
    docs = plain(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in pieces(batches, 2 << 20):
            rows = []
            for row, encoded in enumerate(encoder.encode(filled(batch.column("text")))):
                ids = np.append(encoded.astype("<u4"), np.uint32(end_id))
                for at in range(0, len(ids), longest):
                    part = ids[at : at + longest]
                    rows.append((row, at // longest, at, len(part), zlib.crc32(part.tobytes())))
            row, piece, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    Pieces are written once and numbered there; their number decides the lot, so neither equal
    ``doc_id`` nor equal texts pile up in one. Full sequences stay as they are; the pieces of the
    others are packed again, until one lot holds them or a round fills less than half of them, which
    means that they do not fit together better.
    """
    open_ = cut_lineage(cut(docs, tokenizer, end_id, limits.piece, key, text))
    kind = open_.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    waiting, done = open_.count(), []
    for turn in count():
        lots = max(1, -(-waiting // LOT))
        dealt = open_.withColumn("lot", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(lots)))
        packed = dealt.groupBy("lot").applyInArrow(_pack_lot(limits, turn), f"{columns}, sequence_id bigint, offset bigint, full boolean")
        if lots == 1 and not done:
            return packed.drop("full")
        packed = cut_lineage(packed)
        left = packed.where("NOT full").count()
        if lots == 1 or 2 * left > waiting:
            done.append(packed)
            break
        done.append(packed.where("full"))
        open_, waiting = packed.where("NOT full").drop("sequence_id", "offset", "full"), left
    return reduce(DataFrame.unionByName, done).drop("full")


def _pack_lot(limits: Limits, turn: int):
    def run(lot: pa.Table) -> pa.Table:
        lengths = lot.column("length").to_numpy()
        sequence = assign(lengths, limits)
        order = np.argsort(sequence, kind="stable")
        ahead = np.cumsum(lengths[order]) - lengths[order]
        first = np.r_[True, sequence[order][1:] != sequence[order][:-1]]
        ahead -= np.maximum.accumulate(np.where(first, ahead, 0))
        offset = np.empty(len(lengths), np.int64)
        offset[order] = ahead
        used = np.stack([np.bincount(sequence, w) for w in (lengths, np.ones(len(lengths)), lengths.astype(float) ** 2)])
        capacity = np.array([limits.tokens, limits.documents, limits.cost], float)
        smallest = float(lengths.min())
        # Full: hardly anything is left, or not even the smallest piece of the lot fits.
        least = np.minimum(FULL * capacity, capacity - np.array([smallest, 1, smallest**2]) + 1)
        full = (used >= least[:, None]).any(axis=0)[sequence]
        number = (turn << 56) + (lot.column("lot").to_numpy() << 20) + sequence
        out = lot.drop_columns(["lot"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        return out.append_column("full", pa.array(full))

    return run
