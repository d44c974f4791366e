"""Token counts, token files, packing: equal to the library, exact round trips, capacities."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD, docs, empty, frame, odd, odd_clashing, texts  # noqa: F401
from tokenizers import Tokenizer

from budgetstar.llm import packing, token_counts, token_files
from budgetstar.llm.encoding import SegmentEncoder
from budgetstar.llm.text import segments
from budgetstar.llm.transducer import Counter, reduce_tree, scan

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LETTERS = "ab  \n\t'sé<|endoftext|>0 1の.　\x1c\x85xyzthe ing½ⅧÀ×ÿ'reé́Σ"
ODD_TEXTS = ["", " ", "\n\n", "a" * 3000, " " * 2000, "thethe" * 400, "<|endoftext|> <|startoftext|>x", "they'restaurant's we'll. It'S", "½1a.½", "ΑΣ ΑΣ. aΣ", "<|ENDOFTEXT|> A", "J\u030c H\u0331. A\u030a", "a\rb\r c", "x \n\ny", "\n", "İ K\u212a"]


def library(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return Counter(BYTES)


def made(seed, n=600):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(n)] + ODD_TEXTS


# --- counts --------------------------------------------------------------------------------------


def test_counts_equal_the_library(counter):
    cases = made(1)
    assert [counter.closed(counter.chunk(t)) for t in cases] == [len(i) for i in library(BYTES)(cases)]


def test_maps_of_any_chunks_compose_to_the_whole(counter):
    for text, ids in zip(made(2, 150), library(BYTES)(made(2, 150))):
        for size in (1, 2, 5, 17) if len(text) < 200 else (97, 1000):
            maps = [counter.chunk(c) for c in token_counts.chunks(text, size)]
            assert counter.closed(reduce_tree(maps, counter.compose)) == len(ids)
            assert counter.closed(scan(maps, counter.compose)[-1]) == len(ids)


@given(st.lists(st.text(alphabet="ab \n.", max_size=6), min_size=3, max_size=3))
@settings(deadline=None, max_examples=80)
def test_composition_is_associative(counter, parts):
    a, b, c = map(counter.chunk, parts)
    assert counter.compose(counter.compose(a, b), c) == counter.compose(a, counter.compose(b, c))


def test_the_scan_counts_every_prefix(counter):
    text = "one two  three\nfour 5 six" * 5
    got = token_counts.chunk_positions(text, counter, 7)
    assert got == [len(i) for i in library(BYTES)(text[: 7 * (k + 1)] for k in range(len(got)))]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Counter(WORDS)


def test_counts_of_all_and_of_odd_rows(docs, texts, odd_clashing, empty):
    wanted = dict(zip([i for i, _ in texts], library(BYTES)(t or "" for _, t in texts)))
    for r in token_counts.count_tokens(docs, BYTES).collect():
        assert (r.n_tokens, r.over_limit) == (len(wanted[r.doc_id]), len(wanted[r.doc_id]) > 512)
    rows = token_counts.count_tokens(odd_clashing, BYTES).collect()
    encoded = library(BYTES)(t or "" for _, t in ODD)
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted((len((t or "").encode()), len(e)) for (_, t), e in zip(ODD, encoded))
    assert token_counts.count_tokens(empty, BYTES).count() == 0


# --- encoding ------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_encode_like_whole_texts(path, texts):
    encoder = SegmentEncoder(path)
    cases = made(3) + [t or "" for _, t in texts]
    assert [e.tolist() for e in encoder.encode(pa.array(cases, pa.string()))] == library(path)(cases)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_slices_of_columns_encode_like_their_texts(path, texts):
    cases = [f"é{i} {t or ''}" for i, (_, t) in enumerate(texts)] + ["ä  ö", "ñ"] * 20
    whole, wanted = pa.array(cases, pa.string()), library(path)(cases)
    for at, n in ((0, 50), (7, 90), (150, 90)):
        assert [e.tolist() for e in SegmentEncoder(path).encode(whole.slice(at, n))] == wanted[at : at + n]


def test_forgetting_changes_nothing(monkeypatch, texts):
    from budgetstar.llm import encoding

    monkeypatch.setattr(encoding, "GENERATION", 50)
    encoder, cases = SegmentEncoder(WORDS), [t or "" for _, t in texts[:40]]
    got = [e.tolist() for a in range(0, 40, 5) for e in encoder.encode(pa.array(cases[a : a + 5], pa.string()))]
    assert got == library(WORDS)(cases)


def test_segments_join_to_the_text():
    assert all("".join(segments(t)) == t for t in made(4))


# --- files ---------------------------------------------------------------------------------------


def write(path, documents, width=2):
    with open(path, "wb") as out:
        writer = token_files.Writer(out, width)
        for key, ids in documents:
            writer.add(key, np.array(ids, f"<u{width}").tobytes())
        writer.close()


def read(path):
    store, name = token_files.open_store(str(path))
    return token_files.Reader(store.open_input_file(name))


DOCUMENTS = [(None, [1]), (None, []), *[(k // 2, list(range(k * 1000 % 60_000))) for k in range(80)]]


@pytest.mark.parametrize("width", [2, 4])
def test_files_come_back(tmp_path, width):
    write(tmp_path / "a", DOCUMENTS, width)
    found = list(read(tmp_path / "a").every())
    assert [(k, i.tolist()) for k, _, i in found] == DOCUMENTS
    assert [at for _, at, _ in found] == [sum(len(i) for _, i in DOCUMENTS[:n]) for n in range(len(DOCUMENTS))]


def test_only_frames_of_wanted_documents_are_opened(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 30_000)
    write(tmp_path / "a", DOCUMENTS)
    reader = read(tmp_path / "a")
    assert len(reader.frames) > 20
    found = reader.get([17, 999])
    assert [i.tolist() for i in found[17]] == [i for k, i in DOCUMENTS if k == 17] and 999 not in found
    assert reader.opened <= 4


def test_any_reader_of_the_format_can_read_them(tmp_path):
    write(tmp_path / "a", DOCUMENTS)
    with open(tmp_path / "a", "rb") as file:
        body = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    reader = read(tmp_path / "a")
    assert len(body) == sum(f.size for f in reader.frames)


@pytest.mark.parametrize("place", [0.01, 0.5, 0.97])
def test_changed_bytes_are_noticed(tmp_path, place):
    write(tmp_path / "a", DOCUMENTS)
    raw = bytearray((tmp_path / "a").read_bytes())
    raw[int(len(raw) * place)] ^= 0x55
    (tmp_path / "b").write_bytes(raw)
    with pytest.raises(token_files.CorruptFrame):
        list(read(tmp_path / "b").every())


def check_files(table, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    encoded = [[*i, 0] for i in library(BYTES)(t or "" for _, t in ordered)]
    got = token_files.read_files(token_files.write_files(table, BYTES)).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in encoded)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [k for k, _ in ordered]


def test_files_of_all_and_of_odd_rows(docs, texts, odd, odd_clashing, empty):
    check_files(docs, texts)
    check_files(odd, ODD)
    check_files(odd_clashing, ODD)
    check_files(empty, [])


# --- packing -------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"documents": 3}, {"cost": 3_000_000}, {"documents": 5, "cost": 6_000_000}])
def test_every_capacity_holds(rule, limits):
    limit = packing.Limits(rule=rule, **limits)
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.integers(1, 4097, 700) ** 2 // 4096 + 1, limit.piece)
    bins = packing.assign(lengths, limit)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert len(own) and own.sum() <= limit.tokens and len(own) <= limit.documents and (own**2).sum() <= limit.cost
    bound = max(lengths.sum() / limit.tokens, len(lengths) / limit.documents, (lengths**2).sum() / limit.cost)
    assert bins.max() + 1 <= 1.25 * bound + 1


def test_best_fit_by_hand():
    assert len(set(packing.assign(np.array([3000, 1096, 2000, 2096, 4096]), packing.Limits()))) == 3
    assert packing.assign(np.array([], np.int64), packing.Limits()).tolist() == []


def test_impossible_limits_are_refused():
    for bad in ({"tokens": 0}, {"rule": "first"}, {"cost": 0}):
        with pytest.raises(ValueError):
            packing.Limits(**bad)


def check_packing(table, rows):
    wanted = []
    for (key, _), ids in zip(rows, library(WORDS)(t or "" for _, t in rows)):
        ids = [*ids, 1]
        wanted += [(key, a // 4096, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for a in range(0, len(ids), 4096)]
    got = packing.pack(table, WORDS).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == sorted(wanted, key=repr)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places), sum(w[3] for w in wanted)


def test_packing_of_all_and_of_odd_rows(docs, texts, odd, odd_clashing, empty):
    sequences, tokens = check_packing(docs, texts)
    assert sequences <= 1.02 * tokens / 4096 + 2
    check_packing(odd, ODD)
    check_packing(odd_clashing, ODD)
    assert check_packing(empty, []) == (0, 0)


def test_lots_lose_little(docs, texts, monkeypatch):
    monkeypatch.setattr(packing, "LOT", 40)
    sequences, tokens = check_packing(docs, texts)
    assert sequences <= 1.2 * tokens / 4096 + 10


def test_a_worker_keeps_the_cache_asked_for_last():
    from budgetstar.llm.text import kept_by_worker

    first = kept_by_worker("first", dict)
    assert kept_by_worker("first", dict) is first
    assert kept_by_worker("second", dict) is not first and kept_by_worker("first", dict) is not first


def test_partly_filled_sequences_of_lots_meet_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOT", 600)
    rows = [(i, "one two three four five six seven eight nine ten eleven twelve " + "and more " * (i % 4)) for i in range(5000)]
    sequences, tokens = check_packing(frame(spark, rows), rows)
    assert sequences <= math.ceil(tokens / 4096 * 1.005)


def test_pieces_that_never_fill_a_sequence_end_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOT", 10)
    rows = [(i, "word " * 2500) for i in range(60)]
    sequences, _ = check_packing(frame(spark, rows), rows)
    assert sequences == 60


def test_token_files_ask_for_integer_keys(spark):
    with pytest.raises(TypeError, match="integers"):
        token_files.write_files(frame(spark, [(1, "a")]).selectExpr("cast(doc_id as string) as doc_id", "text"), BYTES)
