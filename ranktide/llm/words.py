"""Words and word windows of whole texts as 64-bit hashes, in numpy.

A hash of a run of values is the difference of two prefix sums of a polynomial in an odd multiplier, times the
inverse power of the run's start, all modulo 2**64; a finaliser mixes it. Runs of any length thus cost two lookups.
Texts are read in slices that end at a separator, so temporaries stay bounded however long a text is."""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
OTHER_MULTIPLIER = 0xD6E8FEB86659FD93
SLICE = 1 << 20

#: bytes of a word: all but space and 0x09 to 0x0D / ASCII letters and digits and every byte of non-ASCII letters
NOT_SPACE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """multiplier**0..n and their inverses modulo 2**64."""
    have = _powers.get(multiplier)
    if have is None or len(have[0]) <= n:
        size = max(4096, 1 << int(n + 1).bit_length())
        both = []
        for m in (multiplier, pow(multiplier, -1, 1 << 64)):
            a = np.full(size, m, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _powers[multiplier] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int = MULTIPLIER) -> np.ndarray:
    """A hash of values[start:end] for each pair."""
    up, down = _power(multiplier, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words begin and end."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], kind[data], [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(text: str | None, kind: np.ndarray = NOT_SPACE) -> np.ndarray:
    """A hash for each word of the whole text (null: none)."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and kind[data[end]]:  # never cut a word
            step = np.flatnonzero(~kind[data[end : end + SLICE]])
            end = end + int(step[0]) if len(step) else min(end + SLICE, len(data))
        part = data[at:end]
        out.append(runs(part, *word_spans(part, kind)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def windows(hashes: np.ndarray, width: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    """A hash for each run of ``width`` consecutive words; shorter texts have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return runs(hashes, starts, starts + width, multiplier)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Windows of ``width`` words; a text of fewer words is one shingle, one without words has none."""
    if 0 < len(hashes) < width:
        width = len(hashes)
    return windows(hashes, width)
