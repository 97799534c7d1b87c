"""Words and word windows of many texts at once, as 64-bit hashes.

Plain numpy over the bytes of an Arrow batch: no Python object per word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_dice = np.random.default_rng(20240131)
_CODE = _dice.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CODE[_IS_BLANK] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    hashes: np.ndarray  # one for each word
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after the last
    first: np.ndarray  # per text: its first word; one entry more than texts


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE)
    p[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


def words(data: np.ndarray, texts: np.ndarray, lower: bool) -> Words:
    """Words are runs of bytes other than blanks; a text ends its last word. `texts`: where each begins."""
    n = len(data)
    if not n:
        return Words(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)), np.zeros(len(texts), np.int64))
    blank = _IS_BLANK[data]
    begins = np.ones(n + 1, bool)
    begins[1:n] = blank[:-1]
    begins[texts] = True
    before = begins[1:]
    before[:-1] |= blank[1:]
    ends = np.flatnonzero(before & ~blank) + 1
    begins = np.ones(n, bool)
    begins[1:] = blank[:-1]
    begins[texts[texts < n]] = True
    starts = np.flatnonzero(begins & ~blank)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), starts, ends, np.zeros(len(texts), np.int64))
    data = data[starts[0] :]
    room = np.diff(np.append(starts, n))  # up to the next word; blanks count nothing
    at = np.arange(len(data), dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), room)
    with np.errstate(over="ignore"):
        terms = _powers(int(room.max()))[at]
        terms *= (_CODE[_LOWER] if lower else _CODE)[data]
        hashes = np.add.reduceat(terms, starts - starts[0])
        hashes += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return Words(mixed(hashes), starts, ends, np.searchsorted(starts, texts))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and which of them lie within one text (by first word)."""
    n = len(found.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        out = found.hashes[:n].copy()
        for k in range(1, size):
            out = mixed(out * np.uint64(3) + found.hashes[k : k + n])
    inside = np.ones(n, bool)
    for k in range(1, size):  # a text that begins at word w breaks the windows that began up to size-1 words before
        broken = found.first[1:-1] - k
        inside[broken[(broken >= 0) & (broken < n)]] = False
    return out, inside
