"""Words, word hashes and shingles of whole texts, in numpy over many documents at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit: a polynomial over the
word's bytes modulo 2**64, by prefix sums, and a mixing step.
"""

from __future__ import annotations

import numpy as np

#: Two independent ones: a span's two hashes are a 128-bit one together.
BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
INVERSES = tuple(np.uint64(pow(int(x), -1, 1 << 64)) for x in BASES)
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
JOIN = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at once; a longer text is taken whole.
SLICE = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[tuple[str, int], np.ndarray] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n."""
    up, down = ("up", which), ("down", which)
    if len(_powers.get(up, ())) <= n:
        size = max(n + 1, SLICE + 1)
        for name, base in ((up, BASES[which]), (down, INVERSES[which])):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
        if n > 16 * SLICE:  # not kept for one very long text
            return _powers.pop(up), _powers.pop(down)
    return _powers[up], _powers[down]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_1
    x ^= x >> np.uint64(29)
    x *= MIX_2
    return x ^ (x >> np.uint64(32))


def prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    """p with p[j] - p[i] = sum of (data[k] + 1) * BASE**k for k from i to j - 1."""
    up, _ = powers(len(data), which)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """The mixed hash of each span of the bytes that prefix() summed: equal for equal bytes."""
    _, down = powers(len(sums), which)
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each document's first word (n + 1 numbers). Words never cross documents."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(BLANK[data], out=inside[1:-1])
    start = inside[1:-1] & ~inside[:-2]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    start[inner] = inside[1:-1][inner]
    starts = np.flatnonzero(start)
    end = inside[1:-1] & ~inside[2:]
    before = inner[inner > 0] - 1
    end[before] |= inside[1:-1][before]
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    return span_hashes(prefix(LOWER[data] if lower else data), starts, ends)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words; with fewer words, of all of them as one; without words, none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = (out * JOIN) ^ words[k : len(words) - n + 1 + k]
        out *= MIX_1
    return mixed(out + np.uint64(n))
