"""Repeated lines, ranked search and hard negatives against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import (  # noqa: F401
    FOLD,
    SMALL,
    docs,
    empty,
    frame,
    odd,
    odd_clashing,
    texts,
    words,
)
from pyspark.sql import functions as F

from budgetstar.llm import lexical, line_dedup, located, negatives
from budgetstar.llm.queries import QUERIES

# --- places and notes ----------------------------------------------------------------------------


def test_stores_are_known_by_the_names_hadoop_uses():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        located.open_store("webhdfs://host/folder")
    assert located.open_store("/tmp/x")[1] == "/tmp/x" == located.open_store("file:/tmp/x")[1]


def test_notes_come_back_to_their_places(spark, docs):
    placed = located.located(docs.select("doc_id", "text"))
    assert placed.select("file", "place").distinct().count() == docs.count()
    notes = placed.select("file", (F.col("place") * 4096).alias("block"), "doc_id")  # as if every row had a block of its own
    for size in (0, 3 << 30):  # one bucket and twelve
        kept = located.keep_notes(notes, size)
        reader = kept.reader()
        for r in placed.orderBy("place").collect():
            assert reader.of(r.file, r.place * 4096).column("doc_id").to_pylist() == [r.doc_id]
            assert reader.of(r.file, r.place * 4096 + 1) is None
        assert reader.of(12345, 0) is None


def test_tables_that_are_no_scan_are_placed_too(spark, odd, empty):
    assert located.located(odd).select("file", "place").distinct().count() == odd.count()
    assert located.located(odd.union(odd)).select("file", "place").distinct().count() == 2 * odd.count()
    assert located.located(empty).count() == 0


# --- repeated lines ------------------------------------------------------------------------------


def cleaned(rows, least_chars=40, least_docs=5):
    """Brute force: lines that stay, number of lines before."""
    held = defaultdict(list)
    keys = [[line.strip(" \t\n\v\f\r").translate(FOLD) for line in (t or "").split("\n")] for _, t in rows]
    for n, own in enumerate(keys):
        for k in set(own):
            if len(k) >= least_chars:
                held[k].append(n)
    last = {}
    for k, who in held.items():
        if len(who) >= least_docs:
            known = [rows[n][0] for n in who if rows[n][0] is not None]
            last[k] = max(known) if known else None
    out = []
    for (doc_id, t), own in zip(rows, keys):
        lines = (t or "").split("\n")
        out.append(([x for x, k in zip(lines, own) if k not in last or last[k] == doc_id], len(lines)))
    return out


def check_lines(spark, rows, **bounds):
    got = [tuple(r) for r in line_dedup.report(frame(spark, rows, clashes=True), **bounds).collect()]
    wanted = []
    for (doc_id, _), (stay, n) in zip(rows, cleaned(rows, **bounds)):
        wanted.append((doc_id, n, n - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


LONG = "This line of forty code points and more stands in many documents"
LINES = ["", LONG, f"  {LONG.upper()}\t", "ä" * 40, "Ä" * 40, "ö" * 39, "short", f"{LONG} but not this one, which is alone"]


def test_lines_against_brute_force(spark):
    pick = random.Random(5)
    rows = [(i, "\n".join(pick.choice(LINES) for _ in range(pick.randint(1, 6)))) for i in range(40)]
    rows += [(None, LONG), (None, None), (7, LONG), (7, LONG), (39, f"{LONG}\r\n\n{LONG}"), (41, "x\n" * 20_000 + LONG), (42, "")]
    check_lines(spark, rows)
    check_lines(spark, rows, least_chars=1, least_docs=2)


def test_line_edges(spark, odd, empty):
    check_lines(spark, [(None, LONG)] * 5)
    check_lines(spark, [(i, LONG) for i in range(4)])
    check_lines(spark, [(i, LONG) for i in range(5)])
    assert line_dedup.report(empty).count() == 0
    assert line_dedup.report(odd).count() == odd.count()


def test_lines_are_taken_out_of_the_text(spark):
    rows = [(i, f"head {i}\n{LONG}\ntail") for i in range(6)] + [(None, None)]
    out = line_dedup.drop_repeated_lines(frame(spark, rows, clashes=True))
    assert out.columns == frame(spark, rows, clashes=True).columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {**{i: f"head {i}\ntail" for i in range(5)}, 5: f"head 5\n{LONG}\ntail", None: None}


@given(st.lists(st.integers(0, 40), min_size=1, max_size=200))
@settings(deadline=None)
def test_filters_suspect_every_repeat(numbers):
    hashes = np.array(numbers, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    pair = line_dedup.FilterPair(len(hashes))
    for at in range(0, len(hashes), 7):  # chunks of any size
        pair.add(hashes[at : at + 7])
    times = Counter(hashes.tolist())
    suspected = dict(zip(hashes.tolist(), pair.suspected(hashes).tolist()))
    assert all(suspected[h] for h, n in times.items() if n > 1)


def test_few_single_hashes_are_suspected():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
    pair = line_dedup.FilterPair(len(hashes))
    pair.add(hashes)
    assert pair.suspected(hashes).mean() < 0.01


# --- ranked search -------------------------------------------------------------------------------


def ranked(rows, items, top=50):
    """Brute force over all documents."""
    counts = [Counter(words(t)) for _, t in rows]
    sizes = [sum(c.values()) for c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for c in counts for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for w, k in df.items()}
    out = []
    for item, text in items:
        asked, scores = set(words(text)), []
        for (doc_id, _), c, size in zip(rows, counts, sizes):
            m = 50 + (50 * size * n) // total if total else 0
            score = sum(weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in asked if c[w])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, doc_id, -score))
    return out


def check_search(spark, rows, items, **options):
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, number string, rank int")
    got = [tuple(r) for r in lexical.search(frame(spark, rows, clashes=True), asked, **options).collect()]
    assert sorted(got, key=repr) == sorted(ranked(rows, items, **options), key=repr)


def test_search_against_brute_force(spark, texts):
    pick = random.Random(9)
    items = [(i, " ".join(pick.sample(words(pick.choice(texts)[1]) or ["none"], 1) + words(pick.choice(texts)[1])[:30])) for i in range(25)]
    check_search(spark, texts, items)
    check_search(spark, texts, items, top=3)


def test_search_edges(spark, odd, empty):
    rows = [(i, "same words here") for i in range(120)] + [(None, "same words"), (None, None), (5, "same words here"), (200, "w " * 200_000), (201, "!")]
    items = [(1, "same"), (1, "same words"), (2, None), (3, "unknown"), (None, "words w w"), (4, "SAME here")]
    check_search(spark, rows, items)
    check_search(spark, [], items)
    check_search(spark, rows, [])
    with pytest.raises(TypeError, match="integer"):
        lexical.search(frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string")), frame(spark, rows).select(F.col("doc_id").alias("item_id"), "text"))


def test_blocks_of_queries_and_small_slices_change_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 200)
    monkeypatch.setattr(lexical, "SLICE", 16)
    monkeypatch.setattr(lexical, "SAMPLE", 20)
    items = [(i, t[:150]) for i, t in texts[:8] if t]
    check_search(spark, texts, items, top=5)


def test_accumulators_stop_and_stay_exact():
    """A common word no longer opens accumulators once rare words have filled the list."""
    rng = np.random.default_rng(1)
    n = 3000
    common, rare = np.arange(n), np.sort(rng.choice(n, 60, replace=False))
    owner = np.r_[common, rare]
    terms = np.r_[np.zeros(n, np.int32), np.ones(60, np.int32)]
    counts = np.r_[rng.integers(1, 4, n), np.ones(60, int)]
    lengths, corpus = np.full(n, 20, np.int64), lexical.Corpus(n, 20 * n)
    part = lexical.Slice(np.arange(n), lengths, owner, terms, counts, corpus)
    asked = [(1, corpus.weight(60)), (0, corpus.weight(n))]
    found, keys = part.search(asked, 50, 0)
    value = lexical.impacts(counts.astype(np.int64), corpus.norms(lengths)[owner])
    whole = np.zeros(n, np.int64)
    np.add.at(whole, owner, value * np.where(terms == 1, asked[0][1], asked[1][1]))
    order = np.lexsort((np.arange(n), -whole))[:50]
    assert keys.tolist() == order.tolist() and found.tolist() == whole[order].tolist()
    assert set(keys) <= set(rare) and not part.open.any() and not part.scores.any()


# --- hard negatives ------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, anchor string, key string"


def mined(rows):
    """Brute force over all pairs."""
    use = [(k, np.floor(256 * np.array(v, np.float64)).astype(int), (c + 1) % 10 if k is not None and k % 7 == 0 else c) for k, v, c in rows
           if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (key, v, label) in enumerate(use):
        if key is None or key % 50:
            continue
        scored = [(-int((v * w).sum()), k is None, k or 0, k, c) for m, (k, w, c) in enumerate(use) if m != n]
        scored.sort(key=lambda x: x[:3])
        for p in [s for s in scored if s[4] == label][:5]:
            inside = [s for s in scored if s[4] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]]
            out += [(key, p[3], rank, s[3], -p[0], -s[0]) for rank, s in enumerate(inside[:3], 1)]
    return out


def check_mined(spark, rows):
    table = spark.createDataFrame([(k, v, c, "x", "y") for k, v, c in rows], VECTORS)
    got = [tuple(r) for r in negatives.mine(table).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert sorted(got, key=repr) == sorted(mined(rows), key=repr)


def vectors(n, dims, seed, scale=0.4):
    rng = np.random.default_rng(seed)
    return [(i, v.astype(np.float32).tolist(), int(c)) for i, (v, c) in enumerate(zip(rng.normal(0, scale, (n, dims)), rng.integers(0, 10, n)))]


def test_negatives_against_brute_force(spark):
    check_mined(spark, vectors(700, 12, 1))


def test_negatives_of_clustered_vectors_and_rare_labels(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (4, 8))
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.05, 8)).astype(np.float32).tolist(), 9 if i in (50, 101) else i % 3) for i in range(301)]
    check_mined(spark, rows)


def test_negative_edges(spark):
    rows = vectors(120, 5, 3)
    rows += [(None, rows[3][1], 4), (50, None, 1), (100, rows[1][1], None), (150, [1.0, None, 0.0, 0.0, 0.0], 2), (200, [float("nan")] * 5, 1)]
    rows += [(250, [float("inf")] * 5, 1), rows[50], rows[50], (300, [0.0] * 5, 3), (350, [], 2), (400, [3000.0, -4000.0, 1.0, 2.0, 3.0], 5)]
    rows += [(i, [0.5] * 5, i % 2) for i in range(401, 440)]  # ties
    check_mined(spark, [(k, v + [0.0] * (5 - len(v)) if v == [] else v, c) for k, v, c in rows])
    check_mined(spark, [])
    short = spark.createDataFrame([(50, [1.0], 1, "", ""), (1, [1.0, 2.0], 1, "", ""), (2, [0.7], 2, "", "")], VECTORS)
    assert [tuple(r) for r in negatives.mine(short).select("positive_id", "negative_id").collect()] == [(1, 2)]


@given(st.integers(0, 10_000), st.integers(1, 30))
@settings(deadline=None, max_examples=40)
def test_threshold_join_finds_every_pair(seed, dims):
    rng = np.random.default_rng(seed)
    top = int(rng.choice([30, 5000, 10**6, 10**8]))
    a, r = rng.integers(-top, top, (6, dims)), rng.integers(-top, top, (9, dims))
    a[:, dims // 2 :] //= 7  # later dimensions are worth leaving out
    order = np.argsort(-np.square(r.astype(float)).sum(axis=0))
    exact = a @ r.T
    least = np.array([rng.choice(exact[i]) for i in range(6)])
    allowed = rng.random((6, 9)) < 0.8
    got = set(zip(*(x.tolist() for x in negatives.threshold_join(negatives.Block(a, order), least, negatives.Block(r, order), allowed))))
    assert got == {(i, j, int(exact[i, j])) for i in range(6) for j in range(9) if allowed[i, j] and exact[i, j] >= least[i]}


def test_products_beyond_the_bound_are_told():
    huge = negatives.Block(np.full((1, 2), 1 << 31), np.arange(2))
    with pytest.raises(OverflowError):
        negatives.threshold_join(huge, np.array([0]), huge, np.array([[True]]))


def test_small_blocks_change_nothing(spark, monkeypatch):
    for name, size in (("ROW_BLOCK", 16), ("ANCHOR_BLOCK", 2), ("LEAST_ROWS", 64), ("LEAST_ANCHORS", 3)):
        monkeypatch.setattr(negatives, name, size)
    check_mined(spark, vectors(400, 10, 8))


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_hard_negatives", "op13_lexical_search"])
def test_queries_are_registered(spark, name):
    assert name in QUERIES and QUERIES[name](spark, SMALL).columns
