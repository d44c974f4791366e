"""Rows, brute-force answers and fixtures shared by the tests of this folder."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
CLASHES = ("shard", "slot", "spans", "sha256", "group", "fingerprint", "words", "row", "score", "kept", "route", "content", "size")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Null key, null and empty texts, blanks only, repeated rows, ties, a very long text.
ODD = [
    (None, "no key here at all, but words enough for a gram"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "Same text, said twice: one two three four five six."),
    (4, "Same text, said twice: one two three four five six."),
    (5, "SAME TEXT, said twice: one two three four five six."),
    (6, "ä" * 50_000),
    (7, "word " * 60_000),
    (8, "!!! ???"),
    (9, "a"),
]


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def frame(spark, rows, clashes=False):
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    table = spark.createDataFrame(full, SCHEMA)
    return table.withColumns({c: F.lit(f"own {c}") for c in CLASHES}) if clashes else table


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def odd_clashing(spark):
    return frame(spark, ODD, clashes=True)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


def near_classes(rows, least=0.8, gram=5):
    """Brute force over all pairs that share a gram: class of each row and its number of links."""
    sets, holders = {}, defaultdict(list)
    for key, text in rows:
        w = words(text)
        k = min(gram, len(w))
        sets[key] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k else set()
        for g in sets[key]:
            holders[g].append(key)
    common = defaultdict(int)
    for keys in holders.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                common[a, b] += 1
    parent, links = {k: k for k in sets}, defaultdict(int)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if n >= least * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[min(x, y)] = max(x, y)
    return {k: (root(k), links[k]) for k in sets}


def contaminated(rows, benchmark, window=10):
    """Brute force: per row the words hit and the items found."""
    grams = defaultdict(set)
    for item, text in benchmark:
        w = words(text)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[a : a + k])].add(str(item))
    found = []
    for _, text in rows:
        w, hit, items = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if who := grams.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    items |= who
        found.append((len(w), len(hit), sorted(items)))
    return found
