"""Toxicity on held-out rows and planted insults; the pipeline stage by stage."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
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
)

from budgetstar.llm import toxicity

MIDDLE = "/root/testdata/sf0.01"


# --- kernel and machine --------------------------------------------------------------------------


def plain_kernel(a, b):
    """Gap-weighted subsequences by enumeration."""
    from itertools import combinations

    def weights(s):
        s, found = f"^{s}$", {}
        for places in combinations(range(len(s)), toxicity.ORDER):
            span = places[-1] - places[0] + 1
            if span <= toxicity.SPAN:
                key = "".join(s[p] for p in places)
                found[key] = found.get(key, 0) + toxicity.DECAY ** (span - toxicity.ORDER)
        return found

    x, y = weights(a), weights(b)
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    return dot / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_kernel_by_enumeration():
    listed = [b"idiot", b"idxiot", b"stupid", b"aaa", "éàé".encode()]
    want = [[plain_kernel(a.decode(), b.decode()) for b in listed] for a in listed]
    assert np.allclose(toxicity.kernel(listed, listed), want)


def test_a_machine_decides_like_its_kernel_expansion():
    machine = toxicity.fit({b"idiot": 5, b"moron": 4}, {b"table": 3, b"house": 2, b"idea": 1})
    scores = machine.decide([b"idiot", b"moron", b"table", b"house"])
    assert (scores[:2] > 0).all() and (scores[2:] < 0).all()


def test_one_class_alone_gives_a_constant():
    assert toxicity.fit({}, {b"a": 1}).decide([b"x"]).tolist() == [-1.0]
    assert toxicity.fit({}, {}).decide([b"x"]).tolist() == [-1.0]


@pytest.mark.parametrize(
    "sentence, wanted",
    [
        (b"You IDIOT, stop", {b"you", b"idiot", b"stop"}),
        (b"i.d.i-o t now", {b"i", b"d", b"o", b"t", b"idiot", b"now"}),
        (b"", set()),
    ],
)
def test_units(sentence, wanted):
    assert toxicity.units(sentence) == wanted


def test_overlong_runs_are_read_whole():
    found = toxicity.units(b"a" * 100 + b"moron" + b"b" * 100)
    assert any(b"moron" in u for u in found) and max(map(len, found)) <= toxicity.LONGEST


# --- trained on invented sentences ---------------------------------------------------------------


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(3)
    syllables = [a + b for a in "bdfklmnrst" for b in "aeiou"]
    insults = ["idiot", "moron", "scumbag", "worthless"]

    def sentence():
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(12))

    rows, labels = [], []
    for key in range(900):
        text = ". ".join(sentence() for _ in range(3))
        if key % 4 == 0:
            text += f". you {rng.choice(insults)} {sentence()}."
        rows.append((key, text))
        labels.append((key, int(key % 4 == 0)))
    table = frame(spark, rows)
    machine = toxicity.train(table, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    return machine, sentence


def test_gapped_and_spelled_insults_are_caught(spark, trained):
    machine, sentence = trained
    spoiled = ["idiot", "idiiot", "id.iot", "i d i o t", "i-d-i-o-t", "IDIOT!", "mor0n moron", "worthlesss", "scum-bag scumbagg"]
    rows = [(i, f"{sentence()} {w} {sentence()}") for i, w in enumerate(spoiled)]
    found = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, rows), machine).collect()}
    assert [spoiled[i] for i, p in found.items() if not p] in ([], ["id.iot"])


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("you i.d.i.o.t now", "idiot"),
        ("you i!d!i!o!t now", "idiot"),
        ("i. d. i. o. t", "idiot"),
        ("plan b. i d i o t", "idiot"),
        ("an id-iot.", "idiot"),
        ("(idi*ot)", "idiot"),
        ("you.are-an_id.i-ot/now", "idiot"),
        ("b l ö d", "blöd"),
        ("b l o\u0308 d", "blo\u0308d"),
    ],
)
def test_cut_words_are_joined_over_the_whole_text(text, wanted):
    assert wanted.encode() in toxicity.units(text.encode())


def test_a_cut_word_beside_an_overlong_run_is_read_whole():
    found = toxicity.units(b"a" * 40 + b"mor-on" + b"b" * 40)
    assert any(b"moron" in u for u in found) and max(map(len, found)) <= toxicity.LONGEST


def test_long_cut_texts_take_linear_time():
    import time

    begin = time.time()
    for text in (b"a." * 300_000, b"a  " * 300_000, b"ab." * 200_000, b"a" + b" " * 500_000 + b"b", b"." * 500_000, b"ab" * 500_000):
        assert max(map(len, toxicity.units(text)), default=0) <= toxicity.LONGEST
    assert time.time() - begin < 30


def test_cut_insults_are_caught(spark, trained):
    machine, sentence = trained
    cut = ["i.d.i.o.t", "i!d!i!o!t", "id.iot", "idi*ot", "id-iot", "mor_on", "w-o-r-t-h-l-e-s-s"]
    rows = [(i, f"{sentence()} {w} {sentence()}") for i, w in enumerate(cut)]
    found = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, rows), machine).collect()}
    assert [cut[i] for i, p in sorted(found.items()) if not p] == []


def test_clean_sentences_are_left_alone(spark, trained):
    machine, sentence = trained
    rows = [(i, ". ".join(sentence() for _ in range(4))) for i in range(300)]
    assert sum(r.predicted for r in toxicity.score(frame(spark, rows), machine).collect()) <= 6


def test_toxicity_of_odd_rows(spark, trained, odd, odd_clashing, empty):
    machine, _ = trained
    rows = toxicity.score(odd, machine).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.held_out for r in rows if r.doc_id == 9} == {zlib.crc32(b"9") % 4 == 2}
    assert toxicity.score(empty, machine).count() == 0
    assert toxicity.drop_toxic(odd_clashing, machine).columns == odd_clashing.columns


def test_training_without_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    some = spark.createDataFrame([(None, 1), (1, None), (4, 1), (4, 1), (6, 0)], "doc_id bigint, toxic int")
    for table, labels in ((empty, none), (odd, none), (odd, some)):
        machine = toxicity.train(table, labels)
        assert toxicity.score(odd, machine).count() == len(ODD)


def test_held_out_rows_of_the_given_tables(spark):
    table, labels = (spark.read.parquet(f"{MIDDLE}/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity.score(table, toxicity.train(table, labels)).where("held_out").join(labels, "doc_id")
    rows = [(r.toxic, r.predicted) for r in scored.collect()]
    assert sum(t == p for t, p in rows) >= 0.9 * len(rows)
    assert sum(t and p for t, p in rows) >= 0.6 * sum(t for t, _ in rows)


def test_copies_of_a_labelled_row_do_not_move_the_threshold(spark):
    machine = toxicity.fit({b"idiot": 5, b"moron": 4}, {b"table": 3, b"house": 2, b"idea": 1})
    toxic = [("you idiot", 1), ("you moron", 1), ("an idiiot", 1)]
    clean = [("a table", 0), ("the house", 0), ("an idea", 0), ("some idiom", 0), ("no idiot", 0)]
    once, often = (
        toxicity._calibrated(machine, spark.createDataFrame([*toxic, *clean, *clean[-1:] * n], "text string, toxic int"))
        for n in (0, 500)
    )
    assert once.middle == often.middle


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, x)).collect()} for x in (labels, turned))
    assert a == b


# --- pipeline ------------------------------------------------------------------------------------


def survivors(table):
    return {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}


def test_each_stage_against_brute_force(spark, docs, tmp_path):
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        before = survivors(current)
        result = stage(spark, current, SMALL)
        result.write.parquet(str(tmp_path / name))
        result = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert set(before) == {r.doc_id for r in result.select("doc_id").distinct().collect()}
            break
        assert result.columns == docs.columns and result.schema == docs.schema
        after = survivors(result)
        assert after.items() <= before.items()
        if name == "toxicity":
            machine = toxicity.train(current, spark.read.parquet(f"{SMALL}/labels.parquet"))
            wanted = {r.doc_id for r in toxicity.score(current, machine).where("predicted = 0").collect()}
        elif name == "exact_dedup":
            last = {}
            for key, text in sorted(before.items()):
                last[(text or "").translate(FOLD)] = key
            wanted = set(last.values())
        elif name == "near_duplicates":
            wanted = {k for k, (c, n) in near_classes(before.items()).items() if n == 0 or c == k}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            wanted = {k for (k, _), (_, n, _) in zip(before.items(), contaminated(before.items(), items)) if n == 0}
        assert set(after) == wanted, name
        current = result


def test_the_pipeline_as_one_query(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns[:2] == ["doc_id", "piece"] and rows.count() > 0


@pytest.mark.parametrize("case", ["odd", "odd_clashing", "empty"])
def test_stages_on_odd_tables(spark, request, case):
    current = request.getfixturevalue(case)
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, current, SMALL)
        if "piece" not in result.columns:
            assert result.columns == current.columns
            current = result
    assert (result.count() > 0) == (case != "empty")
