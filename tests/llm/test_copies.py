"""Exact copies, near copies, benchmark passages."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import (  # noqa: F401
    FOLD,
    ODD,
    SMALL,
    contaminated,
    docs,
    empty,
    frame,
    near_classes,
    odd,
    odd_clashing,
    texts,
    words,
)

from budgetstar.llm import components, decontaminate, exact_dedup, located, near_join
from budgetstar.llm import quotient_filter as qf

# --- quotient filter -----------------------------------------------------------------------------

ENTRIES = st.dictionaries(st.tuples(st.integers(0, 300), st.integers(0, 5)), st.integers(1, 2**40), max_size=60)


def arrays(entries):
    keys = sorted(entries)
    return (
        np.array([q for q, _ in keys], np.uint64),
        np.array([r for _, r in keys], np.uint32),
        np.array([entries[k] for k in keys], np.uint64),
    )


def back(parts):
    return {(int(q), int(r)): int(c) for q, r, c in zip(*parts)}


@given(ENTRIES)
@settings(deadline=None)
def test_filters_come_back(entries):
    assert back(qf.decode(qf.encode(*arrays(entries)))) == entries


@given(ENTRIES, ENTRIES)
@settings(deadline=None)
def test_filters_merge_without_loss(a, b):
    parts = [qf.decode(qf.encode(*arrays(x))) for x in (a, b)]
    merged = qf.merge_sorted(*(np.concatenate(x) for x in zip(*parts)))
    assert back(merged) == {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}


# --- exact copies --------------------------------------------------------------------------------


def groups(rows):
    found = defaultdict(list)
    for key, text in rows:
        found[(text or "").translate(FOLD)].append(key)
    return found


def check_copies(report, rows):
    wanted = []
    for text, keys in groups(rows).items():
        known = [k for k in keys if k is not None]
        keep = max(known) if known else None
        wanted += [(k, keep, len(keys), k == keep, hashlib.sha256(text.encode()).hexdigest()) for k in keys]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in report.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_copies_of_all_documents(docs, texts):
    check_copies(exact_dedup.find_copies(docs), texts)


def test_copies_of_odd_rows(odd, odd_clashing, empty):
    check_copies(exact_dedup.find_copies(odd), ODD)
    check_copies(exact_dedup.find_copies(odd_clashing), ODD)
    assert exact_dedup.find_copies(empty).count() == 0 == exact_dedup.drop_copies(empty).count()


def test_one_row_of_each_text_stays(odd_clashing):
    kept = exact_dedup.drop_copies(odd_clashing)
    assert kept.columns == odd_clashing.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(groups(ODD))
    for text, keys in groups(ODD).items():
        known = [k for k in keys if k is not None]
        assert (max(known) if known else None) in [i for i, t in rows if (t or "").translate(FOLD) == text]


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    check_copies(exact_dedup.find_copies(frame(spark, rows).repartition(16)), rows)
    assert exact_dedup.drop_copies(frame(spark, rows)).count() == 2001


def test_equal_fingerprints_are_not_enough(spark, monkeypatch):
    """All fingerprints alike: bytes alone decide."""
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda _: 7 << 40)
    rows = [(1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, "c")]
    assert {r.fingerprint for r in exact_dedup.fingerprints(located.located(frame(spark, rows))).collect()} == {7 << 40}
    check_copies(exact_dedup.find_copies(frame(spark, rows)), rows)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(frame(spark, rows)).collect()) == [2, 3, 5]


# --- near copies ---------------------------------------------------------------------------------


def test_bands_reach_the_recall():
    n = near_join.band_count(0.8, 5, 0.9999)
    assert 1 - (1 - 0.8**5) ** n >= 0.9999 > 1 - (1 - 0.8**5) ** (n - 1)


def check_classes(report, rows):
    assert {r.doc_id: (r.class_id, r.n_links) for r in report.collect()} == near_classes(rows)


def test_near_copies_of_all_documents(docs, texts):
    check_classes(near_join.report(docs), texts)


def variants(rng, base, n, changes):
    return [" ".join(f"new{rng.random()}" if i in set(rng.sample(range(len(base)), changes)) else w for i, w in enumerate(base)) for _ in range(n)]


@pytest.mark.parametrize("block", [512, 16])
def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_join, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{i}" for i in range(200)]
    made = variants(rng, base, 150, 2) + variants(rng, [f"v{i}" for i in range(60)], 20, 1)
    rows = list(enumerate(made + made[:40] + [" ".join(f"u{rng.random()}" for _ in range(50)) for _ in range(50)]))
    check_classes(near_join.report(frame(spark, rows)), rows)


def test_chains_are_one_class_with_their_own_links(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([f"x{j}" for j in range(2 * k)] + base[2 * k :])) for k in range(12)]
    check_classes(near_join.report(frame(spark, rows)), rows)


def test_near_copies_of_odd_rows(odd, odd_clashing, empty):
    rows = [(i, r.class_id, r.n_links) for r in near_join.report(odd).collect() for i in [r.doc_id]]
    assert len(rows) == len(ODD)
    assert {(i, c, n) for i, c, n in rows if i in (4, 5)} == {(4, 5, 2), (5, 5, 2)}
    assert all((c, n) == (i, 0) for i, c, n in rows if i not in (4, 5))
    assert near_join.report(empty).count() == 0 == near_join.keep_one(empty).count()
    kept = near_join.keep_one(odd_clashing)
    assert kept.columns == odd_clashing.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((i or 0) for i, _ in ODD if i != 4)


def test_repeated_rows_leave_one(spark):
    rows = [(7, "one two three four five six seven")] * 3 + [(None, "alpha beta gamma delta epsilon zeta")] * 2
    kept = near_join.keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 7]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    label = {n: n for e in edges for n in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a, b in edges):
            break
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {n: found.get(n, n) for n in label} == label


# --- benchmark passages --------------------------------------------------------------------------

ITEMS = [(1, "a b c d e f g h i j k"), (2, "short item"), (3, None), (4, "!!!"), (None, "no name"), (2, "q w e r t y u i o p"), (10, "A, b; c d e f g h i j")]
MARKED = [(0, "x A b. c d e f g h i j k y"), (1, "b c d e f g h i j"), (2, "a short item, a SHORT-item"), (3, None), (4, "shorts item no name")]


def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def check_hits(report, rows, items):
    wanted = contaminated(rows, [("" if i is None else i, t) for i, t in items])
    got = {r.doc_id: r for r in report.collect()}
    for (key, _), (n, hit, found) in zip(rows, wanted):
        r = got[key]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_hits_of_all_documents(spark, docs, texts):
    table = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    check_hits(decontaminate.scan(docs, table), texts, [(r.item_id, r.text) for r in table.collect()])


@pytest.mark.parametrize("size", [1, 20, 1 << 22])
def test_hits_by_hand_in_any_number_of_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    check_hits(decontaminate.scan(frame(spark, MARKED), benchmark(spark)), MARKED, ITEMS)


def test_rows_or_spans_go(spark):
    table, items = frame(spark, MARKED, clashes=True), benchmark(spark)
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(table, items).collect()) == [1, 3]
    cut = decontaminate.cut_spans(table, items)
    assert cut.columns == table.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {0: "x  y", 1: MARKED[1][1], 2: "a , a ", 3: None, 4: "shorts item "}


def test_hits_of_odd_rows(spark, odd, odd_clashing, empty):
    items = benchmark(spark)
    rows = decontaminate.scan(odd, items).collect()
    assert sorted(r.n_words for r in rows) == sorted(len(words(t)) for _, t in ODD)
    assert decontaminate.scan(empty, items).count() == 0
    assert decontaminate.drop_contaminated(odd_clashing, items.limit(0)).count() == len(ODD)


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, near_join.keep_one])
def test_rows_that_stay_are_read_in_place(spark, docs, stage):
    """Half of all texts repeated: the last read of the texts has no exchange above it."""
    rows = [(i, f"text number {i // 2 if i % 4 < 2 else i} with some more words behind it") for i in range(200)]
    left = stage(frame(spark, rows))
    text = left._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "MapInArrow" in text
    assert left.count() == len({t for _, t in rows})
