"""A byte-pair tokenizer compiled to finite-state transducers that count emitted tokens.

Two deterministic machines work one after the other:

* Over character classes a machine cuts text into pre-tokens. Its reset places, where white space
  follows anything else, lie between pre-tokens in every state.
* Over bytes a transducer runs through a pre-token. A state is what the merges still depend on: the
  longest suffix that begins some token, and for each place inside it the last token of the text up
  to there. Each transition carries the change of the token count, which is negative where a byte
  lets earlier tokens merge. States and transitions are made when first met and kept in tables.

The last token of a text is the longest suffix token that may follow the last token of the text
before it. Two tokens may follow each other if no merge across their border comes before the merges
that made them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import regex

from budgetstar.llm.text import WHITE, segments

# The pattern that splits text before the merges of the public 50k vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
STATES = 300_000  # states that a worker keeps before it starts anew
SEGMENTS = 300_000  # counted segments that a worker remembers
START = -1
_RESET = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
_LAST = regex.compile(f"(?r)(?<=[^{WHITE}])(?=[{WHITE}])")


def byte_alphabet() -> dict[str, int]:
    """Public byte-level alphabet: printable characters stand for themselves, other bytes for 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Transducer:
    """Tokens of a pre-token, counted by a lazily built deterministic transducer."""

    def __init__(self, merges: list[tuple[bytes, bytes]]) -> None:
        # Token numbers follow the merges, so a lower number was merged earlier.
        self.token = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        for left, right in merges:
            made = (self.token[left], self.token[right])
            number = self.token.setdefault(left + right, len(self.parts))
            if number == len(self.parts):
                self.parts.append(made)
            self.pair[made] = number
        self.prefixes = {t[:n] for t in self.token for n in range(1, len(t))}
        self._follow: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self.root = self._state((b"", (START,), (0,)))

    def _state(self, state: tuple) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
        return number

    def follows(self, first: int, second: int) -> bool:
        """Whether the tokens stay as they are next to each other."""
        known = self._follow.get((first, second))
        if known is None:
            if len(self._follow) > 4 * STATES:
                self._follow.clear()
            known = self._follow[first, second] = self._border(first, second)
        return known

    def _border(self, left: int, right: int) -> bool:
        """Undo the latest merge on either side of the border until both sides are single bytes.

        A merge across the border that comes before every merge undone so far would have been
        applied first, so the two tokens could never have formed.
        """
        undone = len(self.parts)
        while True:
            if self.pair.get((left, right), undone) < undone:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                undone, left = left, self.parts[left][1]
            else:
                undone, right = right + 1, self.parts[right][0]

    def _step(self, number: int, byte: int) -> tuple[int, int]:
        """Build the transition of a state; window entries are places, newest last."""
        suffix, last, counts = self.states[number]
        whole = suffix + bytes([byte])
        found = None
        for at in range(len(last)):  # the longest token first
            token = self.token.get(whole[at:])
            if token is not None and (last[at] == START or self.follows(last[at], token)):
                found = token, counts[at] + 1
                break
        token, count = found
        kept = whole
        while kept and kept not in self.prefixes:
            kept = kept[1:]
        delta = count - counts[-1]
        window, before = (*last, token), (*counts, count)
        size = len(kept) + 1
        after = self._state((kept, window[-size:], tuple(c - count for c in before[-size:])))
        self.next[number][byte] = after, delta
        return after, delta

    def count(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.states) > STATES:
            self._clear()
        state, total, table = self.root, 0, self.next
        for byte in data:
            move = table[state].get(byte)
            if move is None:
                move = self._step(state, byte)
            state = move[0]
            total += move[1]
        return total


def load(path: str) -> tuple[Transducer, list[str]]:
    """The transducer of a byte-level tokenizer file, and its special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not plain or spec["normalizer"] or model.get("end_of_word_suffix"):
        raise ValueError("Only plain byte-level BPE files can be compiled")
    alphabet = byte_alphabet()

    def raw(token: str) -> bytes:
        return bytes(alphabet[c] for c in token)

    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Transducer([(raw(a), raw(b)) for a, b in pairs]), [t["content"] for t in spec["added_tokens"]]


class Counter:
    """Counts of whole texts, as compositions of the maps of their chunks.

    The map of a chunk is (head, count, tail): from any state the machine is reset at the chunk's
    first reset place, so all that depends on what came before is the head, all that a later chunk
    can change is the tail. A chunk without a reset place is (text, None, "").
    """

    def __init__(self, path: str) -> None:
        self.transducer, special = load(path)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Tokens between two reset places; a special string in it is one token."""
        count, at = 0, 0
        for found in self.special.finditer(text) if self.special else ():
            count += 1 + self.ordinary(text[at : found.start()])
            at = found.end()
        return count + self.ordinary(text[at:])

    def ordinary(self, text: str) -> int:
        run: Callable[[bytes], int] = self.transducer.count
        return sum(run(p.encode("utf-8", "surrogatepass")) for p in PATTERN.findall(text))

    def whole(self, text: str) -> int:
        """Tokens of a text that begins and ends at reset places."""
        known, parts = self.known, segments(text)
        if len(known) > SEGMENTS:
            known.clear()
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            for part in parts:
                if part not in known:
                    known[part] = self.segment(part)
            return sum(map(known.__getitem__, parts))

    def chunk(self, text: str) -> tuple[str, int | None, str]:
        """The map of a chunk."""
        first = _RESET.search(text)
        if first is None:
            return text, None, ""
        last = max(first.start(), _last_reset(text))
        return text[: first.start()], self.whole(text[first.start() : last]), text[last:]

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        """The map of two neighbouring chunks; associative."""
        seam = (a[0] if a[1] is None else a[2]) + b[0]
        if a[1] is not None and b[1] is not None:
            return a[0], a[1] + self.whole(seam) + b[1], b[2]
        head, count, tail = self.chunk(seam)
        if a[1] is None and b[1] is None:
            return head, count, tail
        if a[1] is None:
            return (seam, b[1], b[2]) if count is None else (head, count + self.whole(tail) + b[1], b[2])
        return (a[0], a[1], seam) if count is None else (a[0], a[1] + self.whole(head) + count, tail)

    def closed(self, a: tuple[str, int | None, str]) -> int:
        """Tokens of a whole text from the map of all its chunks."""
        return self.whole(a[0]) + (0 if a[1] is None else a[1] + self.whole(a[2]))


def _last_reset(text: str) -> int:
    found = _LAST.search(text)
    return found.start() if found else 0


def scan(maps: list, compose: Callable) -> list:
    """Inclusive prefix scan in log2(n) sweeps; each sweep's compositions are independent."""
    step, maps = 1, list(maps)
    while step < len(maps):
        maps = maps[:step] + [compose(maps[i - step], maps[i]) for i in range(step, len(maps))]
        step *= 2
    return maps


def reduce_tree(maps: list, compose: Callable):
    """The last element of the scan, by pairwise composition."""
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]
