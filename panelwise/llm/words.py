"""Hashes of words and word shingles for whole Arrow slices at once.

Words are the runs of anything but ASCII white space in the lower-cased text.
The hash of a word is a polynomial over its bytes, taken from prefix sums, so a
slice costs a handful of numpy passes and no Python per word. Long texts are hashed
in stretches of whole words, so the sums and powers stay short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelwise.llm.common import strings

SHINGLE_WORDS = 5
STRETCH = 1 << 19

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_PLACES = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers = made[0], made[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the place where each string begins (one more at the end)."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blanks(raw: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return _BLANK[raw]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and byte length of every word, and each text's first word (one more at the end)."""
    raw, begins = string_bytes(pc.utf8_lower(strings(texts)))
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(begins), np.int64)
    solid = ~blanks(raw)
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        # the words that end within a stretch, at least one
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH, "right")))
        base, part = starts[at], raw[starts[at] : ends[to - 1]]
        power, inverse = _tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * power[: len(part)], out=sums[1:])
        hashes[at:to] = (sums[ends[at:to] - base] - sums[starts[at:to] - base]) * inverse[starts[at:to] - base]
        at = to
    return mix(hashes ^ (ends - starts).astype(np.uint64)), ends - starts, np.searchsorted(starts, begins)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; places with fewer words left count absent ones as 0."""
    padded = np.concatenate([hashes, np.zeros(k - 1, np.uint64)])
    total = np.zeros(len(hashes), np.uint64)
    for i in range(k):
        total += padded[i : i + len(hashes)] * _PLACES[i]
    return mix(total)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and each text's first one (one more at the end).

    A text of fewer than k words has one shingle of all its words, one without words none.
    """
    count = np.diff(first)
    every = windows(hashes, k)
    place = np.arange(len(hashes))
    end = np.repeat(first[1:], count)
    keep = place + k <= end
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = first[:-1][short]
        total = np.zeros(len(short), np.uint64)
        for i in range(k):
            there = i < count[short]
            total[there] += hashes[at[there] + i] * _PLACES[i]
        every[at] = mix(total)
        keep[at] = True
    per_text = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    return every[keep], np.concatenate([[0], np.cumsum(per_text)])


def shingle_set(hashes: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(shingles(hashes, np.array([0, len(hashes)]), k)[0])
