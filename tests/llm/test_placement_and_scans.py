"""Sharding, licence scan, personal data: operators on built-in expressions only."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from budgetstar.llm import licenses, pii, sharding
from llm_cases import (  # noqa: F401
    CLASHES,
    ODD,
    docs,
    empty,
    frame,
    odd,
    odd_clashing,
    texts,
    words,
)


def plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


# --- sharding ------------------------------------------------------------------------------------


def test_shares_differ_by_little():
    counts = Counter(sharding.fill(sharding.SHARDS))
    assert sum(counts.values()) == sharding.SLOTS and max(counts.values()) - min(counts.values()) <= 1


def test_weights_give_shares():
    counts = Counter(sharding.fill({"a": 3, "b": 1, "c": 0}, 1009))
    assert 0.74 < counts["a"] / 1009 < 0.76 and "c" not in counts


def test_a_lost_shard_moves_little_more_than_its_own_slots():
    before = sharding.fill(sharding.SHARDS)
    after = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(before, after))
    own = before.count(sharding.SHARDS[-1])
    assert own <= moved <= 3 * own


@pytest.mark.parametrize("shards, slots", [([], 7), (["a"], 8), (["a", "b", "c"], 2), ({"a": 0}, 7), ({"a": -1}, 7)])
def test_impossible_tables_are_refused(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill(shards, slots)


def test_placement_by_hand(odd, odd_clashing, empty):
    table = sharding.fill(sharding.SHARDS)
    rows = sharding.place(odd).collect()
    for r in rows:
        key = f"t{r.text or ''}" if r.doc_id is None else f"k{r.doc_id}"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])
    assert len(rows) == len(ODD) and sharding.place(empty).count() == 0
    clashing = sharding.place(odd_clashing)
    assert sorted(clashing.columns) == sorted(odd_clashing.columns)
    assert sorted(r.slot for r in clashing.collect()) == sorted(r.slot for r in rows)


def test_placement_is_one_broadcast(docs):
    text = plan(sharding.place(docs))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Python" not in text


# --- licences ------------------------------------------------------------------------------------


def base_places(text):
    w, found = words(text), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    return found


def check_base(rows, wanted):
    for r, text in zip(rows, wanted):
        found = base_places(text)
        starts = [k for k, _ in found]
        assert (r.n_words, r.n_base) == (len(words(text)), len(found))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_base_phrases_of_all_documents(docs, texts):
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    check_base([rows[i] for i, _ in texts], [t for _, t in texts])


LICENSED = [
    ("Released under the MIT License.", "mit"),
    ("x MIT, license! y Apache license z mit license", "apache,mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("under the terms of the GNU Lesser General Public License as published", "gpl,lgpl"),
    ("This work is licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("licensed under cc by nc 3.0", ""),  # the mandatory phrase is not there
    ("general public offering of a license", ""),
    ("mitKicense MIT İlicense", ""),  # letters whose lower case looks like ASCII
    ("emit license", ""),
    ("", ""),
]


def test_notices(spark):
    rows = licenses.scan(frame(spark, list(enumerate(t for t, _ in LICENSED)))).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == [x for _, x in LICENSED]
    check_base(rows, [t for t, _ in LICENSED])
    assert rows[0].score == 1.0 and rows[6].score == 0.0


def test_every_notice_of_a_text_is_found(spark, docs):
    rng = random.Random(5)
    sets = [licenses.NOTICES, *([a, b] for a in licenses.NOTICES for b in licenses.NOTICES)]
    sets += [rng.sample(licenses.NOTICES, 3) for _ in range(100)]
    texts = ["\n\n".join(n.text for n in some) for some in sets]
    table = docs.select("doc_id", "text").unionByName(frame(spark, [(-1 - i, t) for i, t in enumerate(texts)]).select("doc_id", "text"))
    found = {r.doc_id: r.labels for r in licenses.scan(table).where("doc_id < 0").collect()}
    lost = [i for i, some in enumerate(sets) if not {n.label for n in some} <= set(found[-1 - i].split(","))]
    assert lost == []


def test_licences_of_odd_rows(odd, odd_clashing, empty):
    assert licenses.scan(empty).count() == 0
    rows = licenses.scan(odd).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == sorted((i or 0, len(words(t))) for i, t in ODD)
    assert sorted(r.n_words for r in licenses.scan(odd_clashing).collect()) == sorted(r.n_words for r in rows)
    assert "Python" not in plan(licenses.scan(odd))


def standing(text, idf):
    """Brute force over all places: labels and score of the notices."""
    w, labels, best = words(text), set(), 0.0
    base = {label for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
    for notice in licenses.NOTICES:
        own, phrase = licenses.notice_words(notice.text), notice.phrase.split()
        at = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
        total = sum(idf[x] for x in own)
        for i in range(len(w)):
            if w[i : i + len(phrase)] == phrase:
                labels.add(notice.label)
                share = sum(idf[x] for k, x in enumerate(own) if 0 <= i - at + k < len(w) and w[i - at + k] == x) / total
                best = max(best, round(min(1.0, share), 6))
    return ",".join(sorted(labels | base)), max(best, 0.5 if base else 0.0)


def test_labels_and_scores_against_brute_force(spark, texts):
    pick = random.Random(3)
    made = []
    for _ in range(150):
        own = [w for n in pick.sample(licenses.NOTICES, 2) for w in licenses.notice_words(n.text)]
        for _ in range(pick.randint(0, 4)):
            own[pick.randrange(len(own))] = pick.choice(["x", "the", "license"])
        made.append(" ".join(own[pick.randint(0, 5) :]))
    rows = [(-1 - n, t) for n, t in enumerate(made)] + texts
    index = licenses.build_index()
    anchored = [set(words(t)) for _, t in rows if set(words(t)) & set(index.anchors)]
    idf = {w: math.log((len(rows) + 1) / (sum(w in a for a in anchored) + 1)) + 0.01 for w in index.vocabulary}
    found = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(spark, rows)).collect()}
    for key, text in rows:
        labels, score = standing(text, idf)
        assert found[key][0] == labels and abs(found[key][1] - score) < 2e-6, text


def test_document_frequencies_are_of_all_rows(spark, texts):
    part = "Licensed under the GNU General Public License, version 2"  # the last word differs from the notice
    others = [(-2, None), (-3, ""), *((-4 - i, "under the sun") for i in range(300))]  # hold no phrase, but its words
    rows = [(-1, part), *others, *texts]
    held = Counter(w for _, t in rows for w in set(words(t)))
    idf = {w: math.log((len(rows) + 1) / (held[w] + 1)) + 0.01 for w in licenses.build_index().vocabulary}
    labels, score = standing(part, idf)
    row = licenses.scan(frame(spark, rows)).where("doc_id = -1").first()
    assert row.labels == labels == "gpl" and abs(row.score - score) < 2e-6


def test_a_long_text_full_of_notices_takes_linear_time(spark):
    notices = " ".join(n.text for n in licenses.NOTICES)
    made = "the of to use " * 250_000 + " ".join([notices] * 50)
    licenses.scan(frame(spark, [(0, notices)])).collect()
    start = time.time()
    row = licenses.scan(frame(spark, [(0, made)])).first()
    assert time.time() - start < 40  # some ten seconds on a machine of its own, most of them for the plan
    assert row.n_words > 1_000_000 and row.labels == ",".join(sorted({n.label for n in licenses.NOTICES})) and row.score == 1.0


def test_a_phrase_has_to_stand_in_its_notice():
    with pytest.raises(ValueError):
        licenses.build_index((licenses.Notice("x", "some text", "other words"),))


# --- personal data -------------------------------------------------------------------------------

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def base_spans(text):
    def valid(kind, found):
        digits = re.sub("[^0-9]", "", found)
        return {
            "email": lambda: True,
            "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 8 <= len(digits) <= 15,
        }[kind]()

    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def check_spans(rows, wanted):
    for r, text in zip(rows, wanted):
        spans = base_spans(text)
        assert [s for s in r.spans.split(",") if s and not s.startswith("iban")] == spans
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s.startswith(k) for s in spans) for k in KINDS]


def test_spans_of_all_documents(docs, texts):
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    check_spans([rows[i] for i, _ in texts], [t for _, t in texts])


TRICKY = [
    "é😀 a.b+c@d-e.f.g. x@y a@b.c_d@e.f a@b@c.d a@b..c a@b.c..d @a.b a@b.c-",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 9999999999999999999.1.1.1 1.2.3.255",
    "4111111111111111 4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 41111111111111111111111",
    "+1 (555) 123-4567 +12 +1234567 +12345678. +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 ++49 30 1234567",
    "1- 2 -3 4--5 6 7",
    "a@b.c" * 300,
    "1.2.3.4" * 300,
    "+1 " * 300,
    "%" * 500 + "@x.y",
    "",
    None,
]


def test_tricky_spans(spark):
    rows = pii.report(frame(spark, list(enumerate(TRICKY)))).orderBy("doc_id").collect()
    check_spans(rows, TRICKY)


def test_random_spans(spark):
    import random

    rng = random.Random(4)
    made = ["".join(rng.choice("ab1234567890.@+- ()-_é") for _ in range(rng.randrange(80))) for _ in range(400)]
    made += ["".join(rng.choice("12.@ +a-") for _ in range(60)) for _ in range(400)]
    check_spans(pii.report(frame(spark, list(enumerate(made)))).orderBy("doc_id").collect(), made)


def test_runs_of_any_length_take_linear_time_and_no_stack(spark):
    long = ["a" * 300_000, "1" * 300_000, "a.b" * 100_000, "1." * 150_000, "a@" * 150_000, "x@" + "y.z" * 100_000, "+1" + " 2" * 150_000]
    assert pii.report(frame(spark, list(enumerate(long)))).count() == len(long)
    rows = pii.report(frame(spark, list(enumerate(long)))).orderBy("doc_id").collect()
    assert rows[5].n_email == 1 and rows[0].spans == ""


def test_many_spans_in_one_text_take_linear_time(spark):
    made = [" ".join(f"u{i}@mail.example.org" for i in range(n)) for n in (100, 200_000)]
    pii.report(frame(spark, [(0, made[0])])).collect()
    start = time.time()
    found = pii.report(frame(spark, [(0, made[1])])).first()
    assert found.n_email == 200_000 and time.time() - start < 30  # some seconds on a machine of its own
    ends = [m.end() for m in re.finditer(r"\S+", made[1])]
    assert [int(s.split(":")[2]) for s in found.spans.split(",")] == ends


def test_account_numbers_end_where_their_country_says(spark):
    good = "ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "GB82WEST12345698765432"
    tails = ("", " EUR 20", " BANK", ".", " 1234 5678", "\nX")
    rows = [f"{head}{iban}{tail}" for iban in good for tail in tails for head in ("", "pay ")]
    bad = ["ES91 2100 0418 4502 0005 1333", "ES9121000418450200051332A", "XES9121000418450200051332", "ZZ93 8601 1117 947"]
    found = pii.report(frame(spark, list(enumerate(rows + bad)))).orderBy("doc_id").collect()
    for text, row in zip(rows, found):
        iban = next(i for i in sorted(good, key=len, reverse=True) if i in text)
        assert f"iban:{text.index(iban)}:{text.index(iban) + len(iban)}" in row.spans.split(","), text
    assert not any("iban" in r.spans for r in found[len(rows) :])


def test_checksums_and_context(spark):
    iban = "GB82 WEST 1234 5698 7654 32"
    rows = [(0, f"bank account {iban}"), (1, f"code {iban[:-1]}3"), (2, "mail me: a@b.cd"), (3, "zz a@b.cd")]
    found = pii.report(frame(spark, rows)).orderBy("doc_id").collect()
    assert [s for s in found[0].spans.split(",") if s.startswith("iban")] == ["iban:13:40"]
    assert "iban" not in found[1].spans
    assert found[2].best_score == 1.0 and found[3].best_score == 0.8


def test_personal_data_of_odd_rows(odd, odd_clashing, empty):
    assert pii.report(empty).count() == 0 and pii.report(odd).count() == len(ODD) == pii.report(odd_clashing).count()
    assert "Python" not in plan(pii.report(odd)) and len(CLASHES) > 0
