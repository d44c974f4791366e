"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel compares short strings by the subsequences they share; a gap costs a factor, so an insult
with characters put in or left out still shares most of them. Labelled documents are bags of such
strings (words, letters spelled one by one, fragments without a blank between them joined, windows
of overlong runs). The machine is trained on the strings that labelled documents are made of, harder
clean strings are added round by round, and a document is as toxic as its worst string.

In landmark coordinates the decision is linear in the subsequence weights of a string, so a trained
machine is a sorted table of subsequences and weights: scoring is one look-up per subsequence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetstar.llm.text import _FOLD, lower_ascii, pieces, plain, texts_of
from budgetstar.sources.shared import cut_lineage

ORDER = 3  # characters of a subsequence
SPAN = 5  # characters it may stretch over
DECAY = 0.6  # factor per character of its stretch
LANDMARKS = 256
LONGEST = 24  # characters of a string; longer runs are read in windows that overlap by half
SAMPLE = 20_000  # labelled documents that are read for training, half of them toxic if there are as many
TELLING = 0.75  # share of toxic documents from which a string may count as toxic
STRINGS = 6_000  # strings per class and round that reach the driver
ROUNDS = 3
THRESHOLD = 0.3
HEAVIEST = 50  # documents up to which a string's weight grows
STEPS = 1_000  # steps per unit to which decisions are rounded when the threshold is set
FARTHEST = 10.0  # decisions beyond count as this one there
KNOWN = 300_000  # strings whose decision a task remembers

_SENTENCE = re.compile(rb"[.!?]+(?=\s)|\n+")
# Bytes that are neither of a word nor blank become one mark, blanks a space.
_MARKED = bytes(32 if b in b"\t\n\v\f\r " else 1 if w == b" " else w[0] for b in range(256) for w in [bytes([b]).translate(_FOLD)])
_CUT = re.compile(rb"(?<![^\x01 ])[^\x01 ]++(?:\x01++[^\x01 ]++)++")  # fragments with marks but no blank between them
# One character with its combining accents, alone between non-words; three or more of them in a row.
_LETTER = rb"(?:[0-9a-z]|[\xc0-\xff][\x80-\xbf]+)(?:\xcc[\x80-\xbf]|\xcd[\x80-\xaf])*+"
_SPELLED = re.compile(rb"(?<![^ ])" + _LETTER + rb"(?: ++" + _LETTER + rb"(?![^ ])){2,}+")
_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]  # places after the first character


def units(text: bytes) -> set[bytes]:
    """Strings of a text: its words, single letters and fragments joined, overlong ones in windows."""
    folded = text.translate(_FOLD)
    found = set(folded.split())
    if _SPELLED.search(folded):
        # Over the whole text, and apart from letters of the sentences before and after.
        for part in (folded, *(s.translate(_FOLD) for s in sentences(text))):
            found.update(run.replace(b" ", b"") for run in _SPELLED.findall(part))
    for cut in set(_CUT.findall(text.translate(_MARKED))):
        found |= joined(cut.split(b"\x01"))
    for long in [u for u in found if len(u) > LONGEST]:
        text = long.decode("utf-8", "replace")
        if len(text) > LONGEST:
            found.discard(long)
            step = LONGEST // 2
            found.update(text[a : a + LONGEST].encode() for a in range(0, len(text) - step, step))
    return found


def joined(fragments: list[bytes]) -> set[bytes]:
    """Neighbouring fragments put together: all of them, and every few that make no overlong string.

    Those of single letters alone are left to the runs of spelled letters.
    """
    parts = [f for f in fragments if f]
    sizes = [len(f.decode("utf-8", "replace")) for f in parts]
    if max(sizes) == 1:
        return set()
    found = {b"".join(parts)}
    for first in range(len(parts) - 1):
        length, several = sizes[first], sizes[first] > 1
        for last in range(first + 1, len(parts)):
            length, several = length + sizes[last], several or sizes[last] > 1
            if length > LONGEST:
                break
            if several:
                found.add(b"".join(parts[first : last + 1]))
    return found


def sentences(text: bytes) -> list[bytes]:
    return _SENTENCE.split(text)


def subsequences(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse kernel coordinates: string number, subsequence, weight; each string has length one."""
    chars = [f"^{s.decode('utf-8', 'replace')}$" for s in strings]
    width = max(map(len, chars), default=1) + SPAN
    table = np.zeros((len(chars), width), np.uint64)
    for length in {len(c) for c in chars}:
        rows = [i for i, c in enumerate(chars) if len(c) == length]
        joined = "".join(chars[i] for i in rows).encode("utf-32-le")
        table[rows, :length] = np.frombuffer(joined, "<u4").reshape(len(rows), length)
    owners, codes, weights = [], [], []
    first = table[:, : width - SPAN]
    for i, j in _OFFSETS:
        second, third = table[:, i : i + width - SPAN], table[:, j : j + width - SPAN]
        row, at = np.nonzero((first > 0) & (third > 0))
        owners.append(row)
        codes.append((first[row, at] << np.uint64(42)) | (second[row, at] << np.uint64(21)) | third[row, at])
        weights.append(np.full(len(row), DECAY ** (j + 1 - ORDER)))
    owner, code, weight = np.concatenate(owners), np.concatenate(codes), np.concatenate(weights)
    order = np.lexsort((code, owner))
    owner, code, weight = owner[order], code[order], weight[order]
    if not len(owner):
        return owner, code, weight
    at = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])
    owner, code, weight = owner[at], code[at], np.add.reduceat(weight, at)
    norm = np.sqrt(np.bincount(owner, weight**2, len(strings)))
    return owner, code, weight / norm[owner]


def kernel(strings: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised kernel values, a row per string."""
    owner, code, weight = subsequences(landmarks)
    codes, number = np.unique(code, return_inverse=True)
    basis = np.zeros((len(codes) + 1, len(landmarks)))
    basis[number, owner] = weight
    out = np.zeros((len(strings), len(landmarks)))
    for a in range(0, len(strings), 512):
        o, c, w = subsequences(strings[a : a + 512])
        at = np.minimum(np.searchsorted(codes, c), max(0, len(codes) - 1))
        hit = codes[at] == c
        np.add.at(out, o[hit] + a, basis[at[hit]] * w[hit, None])
    return out


@dataclass
class Machine:
    """Weights of subsequences, offset, and the logistic curve from decision to score."""

    codes: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float = 4.0
    middle: float = 0.0

    def decide(self, strings: list[bytes]) -> np.ndarray:
        if not strings:
            return np.zeros(0)
        owner, code, weight = subsequences(strings)
        if not len(self.codes):
            return np.full(len(strings), self.offset)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        part = np.where(self.codes[at] == code, self.weights[at], 0.0) * weight
        return np.bincount(owner, part, len(strings)) + self.offset

    def score(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (decision - self.middle), -30, 30)))


def fit(toxic: dict[bytes, int], clean: dict[bytes, int], hard: tuple[bytes, ...] = (), seed: int = 7) -> Machine:
    """Train on strings of both classes with the number of their documents; one class alone gives a constant.

    Landmarks are the commonest toxic strings, the hardest clean ones and some clean ones by chance.
    """
    if not toxic or not clean:
        return Machine(np.zeros(0, np.uint64), np.zeros(0), 1.0 if toxic else -1.0)
    rng = np.random.default_rng(seed)
    by_count = sorted(toxic, key=lambda s: (-toxic[s], s))
    others = [s for s, _ in zip(_shuffled(sorted(clean), rng), range(LANDMARKS // 8))]
    landmarks = list(dict.fromkeys([*by_count[: LANDMARKS // 2], *hard[: 3 * LANDMARKS // 8], *others]))
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-6
    project = vectors[:, keep] / np.sqrt(values[keep])
    x = kernel([*toxic, *clean], landmarks) @ project
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    weight = np.minimum(np.array([*toxic.values(), *clean.values()], float), HEAVIEST)
    w, offset = _hinge(x, y, weight, rng)
    owner, code, weight = subsequences(landmarks)
    codes, number = np.unique(code, return_inverse=True)
    return Machine(codes, np.bincount(number, weight * (project @ w)[owner], len(codes)), offset)


def _shuffled(strings: list[bytes], rng: np.random.Generator) -> list[bytes]:
    return [strings[i] for i in rng.permutation(len(strings))]


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, cost: float = 10.0, passes: int = 40):
    """Linear support vector machine by dual coordinate descent; both classes weigh the same."""
    x = np.c_[x, np.ones(len(x))]
    share = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum())
    bound = cost * len(y) / 2 * share
    alpha, w, size = np.zeros(len(y)), np.zeros(x.shape[1]), (x**2).sum(axis=1)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / size[i], 0.0), bound[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text`` and ``toxic`` of the training sample: all rows of at most SAMPLE values of doc_id, chosen by a hash."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    halves = [
        known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE // 2) for t in (0, 1)
    ]
    return docs.join(F.broadcast(halves[0].unionByName(halves[1])), "doc_id").select("text", "toxic")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean documents have the string."""
    for batch in pieces(batches):
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist()):
            found[1 if toxic else 0].update(units(text))
        strings = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_pydict(
            {
                "string": pa.array(strings, pa.binary()),
                "toxic": pa.array([found[1][s] for s in strings], pa.int64()),
                "clean": pa.array([found[0][s] for s in strings], pa.int64()),
            }
        )


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine from the training rows of ``labels`` (columns doc_id, toxic).

    Counting the strings of labelled documents is a Spark job; the driver gets at most STRINGS
    strings per class and round: the most telling toxic ones, a hash sample of the clean ones, and
    the clean ones that the machine of the round before takes for toxic.
    """
    sample = cut_lineage(_labelled(plain(docs), labels))
    # Copies of a text count once: a word of a copied document is no evidence.
    apart = sample.groupBy(lower_ascii(F.coalesce("text", F.lit(""))).alias("text")).agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in apart.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    share = sizes.get(True, 0) / max(1, sum(sizes.values()))
    counted = apart.mapInArrow(_count, "string binary, toxic bigint, clean bigint")
    counted = cut_lineage(counted.groupBy("string").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    # Chernoff bound on a string being in so many toxic documents by chance; over all strings that
    # are tried, less than one such accident is let through.
    n, part = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    rate = min(max(share, 1e-9), 1 - 1e-9)
    rest = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - rate))).otherwise(F.lit(0.0))
    surprise = n * (part * F.log(part / rate) + rest)
    tried = counted.where("toxic >= 2")
    telling = tried.where((part >= TELLING) & (surprise > math.log(2 * max(1, tried.count()))))
    toxic = {bytes(r.string): r.toxic for r in telling.orderBy(F.desc("toxic"), "string").limit(STRINGS).collect()}
    usual = counted.where((F.col("clean") > 0) & (part < TELLING))
    clean = {bytes(r.string): r.clean for r in usual.orderBy(F.xxhash64("string"), "string").limit(STRINGS).collect()}
    machine = fit(toxic, clean)
    for _ in range(ROUNDS - 1):
        judged = usual.select("string", "clean").mapInArrow(_decisions(machine), "string binary, clean bigint, decision double")
        worst = judged.where("decision > -0.9").orderBy(F.desc("decision"), "string").limit(STRINGS // 2).collect()
        clean |= {bytes(r.string): r.clean for r in worst}
        machine = fit(toxic, clean, tuple(bytes(r.string) for r in worst))
    return _calibrated(machine, sample)


def _decisions(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = machine.decide(batch.column("string").to_pylist())
            yield pa.RecordBatch.from_pydict(
                {"string": batch.column("string"), "clean": batch.column("clean"), "decision": pa.array(values, pa.float64())}
            )

    return run


class Decisions(dict):
    """Decisions of strings, remembered up to a bound."""

    def __init__(self, machine: Machine) -> None:
        super().__init__()
        self.machine = machine

    def worst(self, documents: list[set[bytes]]) -> np.ndarray:
        new = list({u for d in documents for u in d if u not in self})
        if len(self) + len(new) > KNOWN:
            self.clear()
            new = list({u for d in documents for u in d})
        for a in range(0, len(new), 4096):
            self.update(zip(new[a : a + 4096], self.machine.decide(new[a : a + 4096]).tolist()))
        lowest = min(self.machine.offset, -1.0)
        return np.array([max(map(self.__getitem__, d), default=lowest) for d in documents])


def _share_below(values: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Share of the counts whose value lies below each cut; values are sorted."""
    total = np.r_[0, np.cumsum(counts)]
    return total[np.searchsorted(values, cuts)] / total[-1]


def _calibrated(machine: Machine, sample: DataFrame) -> Machine:
    """Put the score 0.3 between the decisions of clean and of toxic training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Decisions(machine)
        for batch in pieces(batches, 2 << 20):
            worst = known.worst([units(t) for t in texts_of(batch.column("text"))])
            steps = np.rint(np.clip(worst, -FARTHEST, FARTHEST) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "step": pa.array(steps)})

    # Copies of a text count once. At most two counts per step reach the driver, however many rows have a labelled doc_id.
    apart = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    steps = apart.mapInArrow(run, "toxic int, step bigint").groupBy((F.col("toxic") > 0).alias("toxic"), "step").agg(F.count("*").alias("n"))
    rows = sorted((r.step, r.n, r.toxic) for r in steps.collect())
    high = [np.array([(s / STEPS, n)[k] for s, n, toxic in rows if toxic]) for k in (0, 1)]
    low = [np.array([(s / STEPS, n)[k] for s, n, toxic in rows if not toxic]) for k in (0, 1)]
    if not len(high[0]) or not len(low[0]):
        return machine
    cuts = np.unique(np.r_[high[0], low[0]])
    cuts = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    missed, wrong = _share_below(*high, cuts), 1 - _share_below(*low, cuts)
    best = np.flatnonzero(missed + 3 * wrong == (missed + 3 * wrong).min())  # a clean document weighs three times
    cut = float((cuts[best[0]] + cuts[best[-1]]) / 2)
    slope = 4.0
    return Machine(machine.codes, machine.weights, machine.offset, slope, cut + float(np.log(1 / THRESHOLD - 1)) / slope)


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` per input row; null text counts as empty."""
    docs = plain(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Decisions(machine)
        for batch in pieces(batches, 2 << 20):
            worst = known.worst([units(t) for t in texts_of(batch.column("text"))])
            ids = ["" if i is None else str(i) for i in batch.column("doc_id").to_pylist()]
            scores = machine.score(worst)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "held_out": pa.array([zlib.crc32(i.encode()) % 4 == 2 for i in ids], pa.bool_()),
                    "score": pa.array(scores, pa.float64()),
                    "predicted": pa.array((scores >= THRESHOLD).astype(np.int32)),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows whose score stays below the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Decisions(machine)
        for batch in pieces(batches, 2 << 20):
            worst = known.worst([units(t) for t in texts_of(batch.column(text))])
            yield batch.filter(pa.array(machine.score(worst) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
