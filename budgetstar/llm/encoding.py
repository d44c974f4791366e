"""Token ids of whole texts, piece by piece, with the tokenizers library."""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from budgetstar.llm.text import kept_by_worker, segments

GENERATION = 250_000  # pieces of a generation; a worker remembers two, about 150 bytes a piece
JOINED = 256  # new pieces that are encoded in one text, with a special string between them

# A run of Latin letters ends before ASCII punctuation in any public pattern.
_MARKS, _LATIN = string.punctuation, "A-Za-zÀ-ÖØ-öø-ɏ"
_CUT = f"(?s)^(?:[{_LATIN}]|[^\\r\\n].*[{_LATIN}])[!-/:-@\\[-`{{-~]+$"
_WORD = f"^[{_LATIN}]+$"
_WHITE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_COMBINING = "\\x{300}-\\x{36f}"  # lower case and composition do not commute behind some letters


class Pieces:
    """Numbered pieces; their ids stand in one growing array."""

    def __init__(self, dtype: np.dtype) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.ends = np.empty(1 << 12, dtype), np.zeros(1 << 10, np.int64)  # ends[n]: where piece n starts

    def find(self, keys: list[str]) -> np.ndarray:
        """The number of each piece, -1 if it is unknown."""
        return np.fromiter(map(self.numbers.get, keys, repeat(-1)), np.int64, len(keys))

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New pieces, their ids one behind the other."""
        n, m = len(self.numbers), len(keys)
        used = int(self.ends[n])
        self.ids = _grown(self.ids, used + len(ids))
        self.ends = _grown(self.ends, n + m + 1)
        self.ids[used : used + len(ids)] = ids
        self.ends[n + 1 : n + m + 1] = used + np.cumsum(sizes)
        self.numbers.update(zip(keys, range(n, n + m)))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one behind the other, and how many each has."""
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        ends = np.cumsum(sizes)
        at = np.repeat(starts - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], sizes


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.empty(max(size, len(array) * 3 // 2), array.dtype)
    out[: len(array)] = array
    return out


class SegmentEncoder:
    """Ids of texts; equal to encoding each whole text at once.

    Texts are cut where white space follows anything else, which no pre-token spans. A batch is cut
    and its pieces are numbered in Arrow, so Python only sees distinct pieces, and the library only
    those that are new. In the table of known pieces a piece behind a blank stands without it; a
    piece that starts otherwise is marked by a leading line feed of its own or a carriage return.
    Texts in which this marking could mislead (two white spaces in a row, carriage returns, special
    strings) are cut by an expression instead.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark spreads the work over cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        highest = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2" if highest < 1 << 16 else "<u4")
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        normalizer = self.tokenizer.normalizer
        self.folds = normalizer is not None and normalizer.normalize_str("ABC") == "abc"
        odd = [f"[{_WHITE}]{{2}}", "(?s:.\\r)", *([f"[{_COMBINING}]"] if self.folds else []), *map(re.escape, self.special)]
        self.odd = "|".join(odd)
        self.edge, self.edge_leads = self._edges()
        self.young, self.old = Pieces(self.dtype), Pieces(self.dtype)

    def _edges(self) -> tuple[np.ndarray | None, bool]:
        """For each id, whether a token with it starts (or ends) a word of letters behind a blank; None if tokens do not say."""
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        leads = not suffix
        edge = np.zeros(max(tokens.values()) + 1, bool)
        marked = [i for t, i in tokens.items() if (t.startswith("Ġ") if leads else t.endswith(suffix))]
        edge[marked] = True
        return (edge, leads) if marked else (None, leads)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string column without nulls."""
        plain = texts.to_pylist()
        # A new array: joining text to a slice of another one is not safe in Arrow.
        marked = pa.array(["\r" + t for t in plain], pa.large_string())
        marked = pc.ascii_lower(marked) if self.folds else marked
        odd = pc.match_substring_regex(marked, self.odd).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(plain)
        usual = marked.filter(pa.array(~odd)) if odd.any() else marked
        for row, ids in zip(np.flatnonzero(~odd).tolist(), self._encode_usual(usual)):
            out[row] = ids
        for row in np.flatnonzero(odd).tolist():
            numbers = self._known(["\r" + s for s in segments(plain[row])])
            out[row] = self.young.take(numbers)[0]
        return out

    def _encode_usual(self, marked: pa.Array) -> list[np.ndarray]:
        """Ids of texts that begin with a mark."""
        if not len(marked):
            return []
        parts = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        listed = parts.flatten().dictionary_encode()
        numbers = self._known(_strings(listed.dictionary))
        ids, sizes = self.young.take(numbers[listed.indices.to_numpy(zero_copy_only=False)])
        borders = np.r_[0, np.cumsum(sizes)][parts.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]

    def _known(self, keys: list[str]) -> np.ndarray:
        """Numbers of pieces among the young ones, where all of them are afterwards."""
        if len(self.young.numbers) > GENERATION:
            self.young, self.old = Pieces(self.dtype), self.young
        numbers = self.young.find(keys)
        open_ = np.flatnonzero(numbers < 0).tolist()
        if open_:
            missing = [keys[i] for i in open_]
            self._learn(self._kept(list(dict.fromkeys(missing))))
            numbers[open_] = self.young.find(missing)
        return numbers

    def _kept(self, keys: list[str]) -> list[str]:
        """Take over what the old generation knows; returns the rest."""
        numbers = self.old.find(keys)
        again = numbers >= 0
        self.young.add([keys[i] for i in np.flatnonzero(again).tolist()], *self.old.take(numbers[again]))
        return [keys[i] for i in np.flatnonzero(~again).tolist()]

    def _learn(self, new: list[str]) -> None:
        """Encode new pieces; punctuation behind a word is encoded apart, so the word is known next time."""
        listed = pa.array(new, pa.large_string())
        cut = pc.match_substring_regex(listed, _CUT)
        apart = listed.filter(cut)
        words, apart = _strings(pc.utf8_rtrim(apart, _MARKS)), _strings(apart)
        marks = ["\r" + k[len(w) :] for k, w in zip(apart, words)]
        parts = dict.fromkeys([*_strings(listed.filter(pc.invert(cut))), *words, *marks])
        known = self.young.numbers
        self._ask(self._kept([p for p in parts if p not in known]))
        ids, sizes = self.young.take(np.stack([self.young.find(words), self.young.find(marks)], axis=1).ravel())
        self.young.add(apart, ids, sizes.reshape(-1, 2).sum(axis=1))

    def _ask(self, keys: list[str]) -> None:
        """Encode many pieces in one text: words of letters joined as they are, others with a special string between."""
        if self.edge is not None:
            plain = pc.match_substring_regex(pa.array(keys, pa.large_string()), _WORD).to_numpy(zero_copy_only=False)
            keys = self._ask_words([k for k, p in zip(keys, plain.tolist()) if p]) + [k for k, p in zip(keys, plain.tolist()) if not p]
        texts = [k[1:] if k[:1] == "\r" else k if k[:1] == "\n" else f" {k}" for k in keys]
        if not self.special:
            self._ask_one_by_one(keys, texts)
            return
        (mark, number), *others = self.special.items()
        groups = []
        for a in range(0, len(keys), JOINED):
            joined = mark.join(texts[a : a + JOINED])
            if joined.count(mark) == len(texts[a : a + JOINED]) - 1 and not any(o in joined for o, _ in others):
                groups.append((a, joined))
            else:
                self._ask_one_by_one(keys[a : a + JOINED], texts[a : a + JOINED])
        for (a, _), ids in zip(groups, self._encoded([j for _, j in groups])):
            borders = np.flatnonzero(ids == number)
            self.young.add(keys[a : a + JOINED], np.delete(ids, borders), np.diff(np.r_[-1, borders, len(ids)]) - 1)

    def _ask_words(self, keys: list[str]) -> list[str]:
        """Encode words whose borders the tokens show; returns those of groups where they do not."""
        groups = [keys[a : a + JOINED] for a in range(0, len(keys), JOINED)]
        left = []
        for group, ids in zip(groups, self._encoded([" " + " ".join(g) for g in groups])):
            edges = np.flatnonzero(self.edge[ids])
            borders = np.r_[edges, len(ids)] if self.edge_leads else np.r_[0, edges + 1]
            if len(edges) == len(group) and borders[0] == 0 and borders[-1] == len(ids):
                self.young.add(group, ids, np.diff(borders))
            else:
                left += group
        return left

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        for b in range(0, len(texts), 64):
            for found in self.tokenizer.encode_batch_fast(texts[b : b + 64], add_special_tokens=False):
                yield np.array(found.ids, self.dtype)

    def _ask_one_by_one(self, keys: list[str], texts: list[str]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.young.add(keys, np.fromiter(chain.from_iterable(encoded), self.dtype), np.array([len(e) for e in encoded], np.int64))


def _strings(column: pa.Array) -> list[str]:
    """Many short strings; to_pylist would take ten times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


def encoder(path: str) -> SegmentEncoder:
    """The encoder of this worker process for a tokenizer file."""
    return kept_by_worker(f"encoder {path}", lambda: SegmentEncoder(path))


def filled(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty texts."""
    return pc.fill_null(column, "")
