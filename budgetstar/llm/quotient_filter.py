"""Counting quotient filter: sorted remainders in runs per quotient, counts in extra slots.

A fingerprint is split into a quotient and a 32-bit remainder. Slots hold the remainders of a
quotient as one sorted run. ``occupied`` marks quotients that have a run, ``runend`` the last slot
of a run, ``digit`` slots that hold base-2^32 digits of the count of the remainder before them
(only counts above one have any). Two filters merge without loss: their entries are sorted, equal
fingerprints add up.
"""

from __future__ import annotations

import struct

import numpy as np

REMAINDER_BITS = 32
_HEAD = "<QQQ"


def merge_sorted(quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
    """Entries in order of quotient and remainder, equal ones added up."""
    if not len(quotients):
        return quotients, remainders, counts
    order = np.lexsort((remainders, quotients))
    quotients, remainders, counts = quotients[order], remainders[order], counts[order]
    first = np.r_[True, (quotients[1:] != quotients[:-1]) | (remainders[1:] != remainders[:-1])]
    at = np.flatnonzero(first)
    return quotients[at], remainders[at], np.add.reduceat(counts, at)


def encode(quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> bytes:
    """A filter as bytes; entries have to come out of ``merge_sorted``."""
    low, high = (counts & 0xFFFFFFFF).astype(np.uint32), (counts >> np.uint64(32)).astype(np.uint32)
    digits = np.where(counts == 1, 0, np.where(high == 0, 1, 2))
    width = 1 + digits
    start = np.cumsum(width) - width
    total = int(width.sum())
    slots, digit, runend = np.zeros(total, np.uint32), np.zeros(total, bool), np.zeros(total, bool)
    slots[start] = remainders
    for k, part in ((1, low), (2, high)):
        has = digits >= k
        slots[start[has] + k], digit[start[has] + k] = part[has], True
    base = int(quotients[0]) if len(quotients) else 0
    size = int(quotients[-1]) - base + 1 if len(quotients) else 0
    occupied = np.zeros(size, bool)
    if size:
        occupied[(quotients - np.uint64(base)).astype(np.int64)] = True
        last = np.r_[quotients[1:] != quotients[:-1], True]
        runend[(start + digits)[last]] = True
    bits = b"".join(np.packbits(x).tobytes() for x in (occupied, runend, digit))
    return struct.pack(_HEAD, base, size, total) + bits + slots.astype("<u4").tobytes()


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotients, remainders and counts, sorted."""
    base, size, total = struct.unpack_from(_HEAD, data)
    at, marks = struct.calcsize(_HEAD), []
    for n in (size, total, total):
        step = (n + 7) // 8
        marks.append(np.unpackbits(np.frombuffer(data, np.uint8, step, at), count=n).astype(bool))
        at += step
    occupied, runend, digit = marks
    slots = np.frombuffer(data, "<u4", total, at).astype(np.uint32)
    present = np.flatnonzero(occupied).astype(np.uint64) + np.uint64(base)
    run = np.cumsum(np.r_[0, runend[:-1]]).astype(np.int64) if total else np.zeros(0, np.int64)
    own = np.flatnonzero(~digit)
    after = np.append(digit, [False, False])
    wide, padded = slots.astype(np.uint64), np.append(slots.astype(np.uint64), [0, 0]).astype(np.uint64)
    one, two = after[own + 1], after[own + 1] & after[np.minimum(own + 2, total + 1)]
    counts = np.where(one, padded[own + 1], np.uint64(1)) + np.where(two, padded[np.minimum(own + 2, total + 1)] << np.uint64(32), np.uint64(0))
    return present[run[own]], wide[own].astype(np.uint32), counts
